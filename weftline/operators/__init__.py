"""Operators on dialogue records and on the events of monitored sessions."""
