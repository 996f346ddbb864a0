"""gleanspark.streaming."""
