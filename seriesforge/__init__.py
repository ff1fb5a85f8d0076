"""Official-statistics submission engine built on Spark DataFrames."""
