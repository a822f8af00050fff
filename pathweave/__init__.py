"""Spark-native building, validating and querying of pedestrian routing graphs."""
