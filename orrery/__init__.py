"""Spark-native engine for particle snapshots, halo catalogues and their queries."""
