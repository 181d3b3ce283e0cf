"""A Spark-native engine for population-scale social networks."""
