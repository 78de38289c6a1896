"""Spark-native engine for tabular dataset search: profile, index, retrieve, fuse, evaluate."""
