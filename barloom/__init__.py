"""barloom: causal multi-timeframe time-series analytics, written as Spark DataFrame jobs."""
