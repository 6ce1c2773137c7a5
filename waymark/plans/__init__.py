"""Registered queries: library operators bound to the driver's tables, with their SQL twins."""
