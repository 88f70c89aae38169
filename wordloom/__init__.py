"""Spark-native engine for time-aligned transcripts, packing, ranking and evaluation."""
