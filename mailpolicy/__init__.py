"""Mail-sender policy and DNS query-log measurement on Spark DataFrames."""
