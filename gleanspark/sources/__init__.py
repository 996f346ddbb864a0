"""gleanspark.sources."""
