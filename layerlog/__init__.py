"""layerlog: a Spark-native engine for printer telemetry and training-data preparation."""
