"""Freight and supply-chain analytics as composable PySpark DataFrame operators."""
