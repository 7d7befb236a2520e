"""quern: corpus preparation, audit and evaluation queries on Spark DataFrames."""
