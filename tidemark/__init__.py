"""Tidemark: multi-source time-series fusion, labelling and verification as plain PySpark DataFrame operators."""
