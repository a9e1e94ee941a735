"""Match-tracking analytics as PySpark DataFrame and Structured Streaming operators."""
