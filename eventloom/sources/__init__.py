"""Readers, tables, views over the star schema, and writers."""
