"""Operators: functions from an event DataFrame to a result DataFrame."""
