"""A Spark-native engine for analysing long-form text."""
