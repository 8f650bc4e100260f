"""Spark-native sequence-graph analytics: reads, k-mers, graphs, placements, statistics."""
