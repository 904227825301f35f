"""Operators for preparing training data: sharding, tokenising, similarity joins, archives, filters, mixing and scans.

Nothing outside this subpackage imports it. Each module holds one operator with its own general interface;
``queries`` holds the thin queries that apply them to the driver's tables.
"""
