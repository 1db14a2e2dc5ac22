"""Readers and writers: review tables, payloads, page identifiers, lexicons and dictionaries."""
