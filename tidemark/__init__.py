"""Spark-native operation-inventory analytics: evidence tables in, routed inventories out."""
