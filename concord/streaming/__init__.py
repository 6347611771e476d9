"""Structured Streaming: progress folding, stall detection, complete lines."""
