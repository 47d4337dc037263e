"""A Spark-native analytics engine for the long-term memory of agents."""
