"""Property-graph analytics on Spark: vertices and edges are DataFrames, operators map DataFrames to DataFrames."""
