"""linkwell: record linkage and corpus preparation on Spark DataFrames."""
