"""Tidewater: Spark-native operators for dated, mixed-frequency series."""
