"""PySpark-native engine for watching changing sources and preparing text corpora."""
