"""Queries over the given tables: each operator on data Spark derives from them, with its SQL twin."""
