"""gleanspark.functions."""
