"""Environmental data operators on Spark: every operator maps DataFrames to a DataFrame."""
