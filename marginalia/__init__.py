"""Marginalia: a PySpark-native engine for corpora of annotated, cited passages."""
