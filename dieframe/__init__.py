"""Analytics of parametric-test measurements as Spark DataFrames."""
