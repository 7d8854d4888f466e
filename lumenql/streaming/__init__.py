"""Nothing here: all statements of this engine are batches. Spark's own
Structured Streaming is not wrapped."""
