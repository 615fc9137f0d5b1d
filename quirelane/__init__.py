"""Spark-native document analytics: layout, tables, search, profiles, diff, receipts and their sources and sinks."""
