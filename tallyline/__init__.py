"""Spark-native engine that finds invoices which may be paid twice."""

__version__ = "0.1.0"
