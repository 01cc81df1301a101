"""Operators over log tables: validation, filters, search, counts, rollups, retention."""
