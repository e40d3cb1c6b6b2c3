"""Operators over lazy frames: incremental algebra, change data, analytics."""
