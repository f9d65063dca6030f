"""Fleet-scale lineage of business-intelligence projects as Spark DataFrames."""
