"""Market-data analytics on Spark DataFrames: bars, features, risk, signals, checks."""
