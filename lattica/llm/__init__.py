"""Operators for preparing training text: scans, deduplication, filters, packing and archives.

Nothing else in the library imports this subpackage.
"""
