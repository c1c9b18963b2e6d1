"""Road-network and traffic-count analytics on Spark DataFrames."""
