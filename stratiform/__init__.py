"""Layered (bronze, silver, gold) table and stream operators for PySpark."""
