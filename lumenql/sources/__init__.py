"""Catalog descriptors, delimited text, databases and sinks."""
