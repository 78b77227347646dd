"""tickloom: a Spark-native engine for ordered market-style time series."""
