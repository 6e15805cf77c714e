"""A Spark-native engine that finds and replaces sensitive spans and accounts for what it inspected."""
