"""gleanspark: Spark-first analytics for gridded observations, tracks, catalogs and corpora."""
