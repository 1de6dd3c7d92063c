"""A Spark-native engine that measures how well pages and documents can be read by machines."""
