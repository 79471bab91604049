"""A PySpark-native graph-analytics engine: graphs, bipartite collections and patterns as DataFrames."""
