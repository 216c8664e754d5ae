"""Spark-native analytics over partitioned, epoch-structured append-only logs."""
