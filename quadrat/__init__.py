"""Spark-native analytics for georeferenced, dated, multi-valued observation records."""
