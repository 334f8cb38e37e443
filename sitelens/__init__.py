"""Screening of the web's publications as Spark tables."""
