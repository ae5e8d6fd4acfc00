"""quern: record linkage and corpus preparation planned as Spark DataFrames."""
