"""Imbalanced-class evaluation as lazy Spark DataFrame operators."""
