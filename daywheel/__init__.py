"""daywheel: a PySpark-native engine for daily multi-station time series."""
