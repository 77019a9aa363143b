"""Sequence-mapping analytics as Spark plans."""
