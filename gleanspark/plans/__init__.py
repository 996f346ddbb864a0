"""gleanspark.plans."""
