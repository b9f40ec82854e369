"""docloom: document scoring and corpus processing on Spark DataFrames."""
