"""A Spark-native engine for the long-lived facts, events and preferences an assistant gathers."""
