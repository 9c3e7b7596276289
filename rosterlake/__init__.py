"""rosterlake: a Spark-native engine for merged entity stores."""
