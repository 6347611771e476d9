"""concord: reconciliation of document contents as Spark DataFrame operations."""
