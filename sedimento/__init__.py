"""A PySpark-native engine for curating multi-modal sample catalogs."""
