"""Spark-native analytics for calibration data."""
