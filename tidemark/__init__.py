"""Point-in-time analytics for many-symbol time series, built on PySpark."""
