"""Relational operators over pages, page stores, access logs and statistics."""
