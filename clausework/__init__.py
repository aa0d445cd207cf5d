"""A PySpark-native engine for turning documents into traceable, reviewable relations."""

__version__ = "0.1.0"
