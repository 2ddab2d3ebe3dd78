"""Metered-usage event processing on Spark: DataFrame in, DataFrame out."""
