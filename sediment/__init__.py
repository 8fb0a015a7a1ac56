"""Tamper-evident change analytics as Spark plans."""
