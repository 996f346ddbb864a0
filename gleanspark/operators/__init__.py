"""gleanspark.operators."""
