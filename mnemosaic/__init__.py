"""Spark-native analytics for knowledge stores: retrieval, graphs, lifecycles, telemetry and text mining."""
