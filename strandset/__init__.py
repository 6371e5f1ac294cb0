"""Spark-native analytics for variant sets, intervals, ranks and resampling."""
