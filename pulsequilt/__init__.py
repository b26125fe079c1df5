"""Spark-native analytics for multi-lead physiological recordings."""
