"""Trace, graph and interval analytics expressed as Spark DataFrame plans."""
