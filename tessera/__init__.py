"""Spark-native hybrid retrieval: tables in, ranked and scored tables out."""
