"""axonspark: a Spark-native analytics engine for synaptic-connectivity tables."""
