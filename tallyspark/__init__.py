"""A Spark-native engine for account-statement data."""
