"""Jobs for log data at scale, on Spark DataFrames, SQL and Structured Streaming."""
