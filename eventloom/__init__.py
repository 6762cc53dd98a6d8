"""Event analytics as Spark DataFrame operators."""
