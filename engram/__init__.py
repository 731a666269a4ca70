"""Engram: retrieval, rules, folds and capture analytics over activity memory, on PySpark."""
