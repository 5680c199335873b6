"""Spark-native analytics for protein-ligand activity tables and texts about them."""

__version__ = "0.1.0"
