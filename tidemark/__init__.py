"""Spark-native engine for turning periodic field-report text into a georeferenced, queryable dataset."""
