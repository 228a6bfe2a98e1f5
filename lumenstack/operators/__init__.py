"""Relational operators of the archive: deduplication, pairing, naming, albums, sidecars, catalog rows."""
