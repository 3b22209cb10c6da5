"""barwright: Spark-native price-bar analytics."""
