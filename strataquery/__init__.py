"""Spark-native analytics over corpora of files, symbols, edges, tokens and change events."""
