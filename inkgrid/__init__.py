"""inkgrid: drawing analytics on Spark DataFrames."""
