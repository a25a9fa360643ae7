"""Documentation-lineage analytics on Spark DataFrames."""
