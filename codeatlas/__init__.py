"""codeatlas: a PySpark-native analytics engine for source code and document collections."""
