"""A PySpark-native engine that aligns and diagnoses related time series."""
