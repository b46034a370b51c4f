"""tracequarry: a PySpark-native engine for logs of long-running automated experiments."""
