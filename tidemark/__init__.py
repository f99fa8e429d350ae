"""Time-series features, forecasting and uncertainty as Spark DataFrame operators."""
