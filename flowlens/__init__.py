"""flowlens: money-flow analytics on Spark DataFrames."""
