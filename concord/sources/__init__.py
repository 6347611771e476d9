"""Sources and sinks: Office files, staged tables, embedding caches."""
