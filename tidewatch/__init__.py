"""tidewatch: a PySpark-native engine that judges whether tabular data is healthy, stable and ready for modelling."""
