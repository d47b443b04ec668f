"""PySpark-native provenance-graph summariser."""
