"""tallygraph: exact and approximate counts of small patterns in large graphs, on Spark DataFrames."""
