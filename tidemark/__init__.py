"""Market time series on Spark: DataFrame operators keyed by symbol, interval and time."""
