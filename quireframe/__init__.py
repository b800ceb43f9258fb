"""Corpus analytics and text-data processing as lazy Spark plans."""

__version__ = "0.1.0"
