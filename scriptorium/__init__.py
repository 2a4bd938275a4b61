"""Scriptorium: a Spark-native engine for corpora of long-form text, pages and news."""
