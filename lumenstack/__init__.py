"""Lumenstack: a PySpark engine for cataloguing and organising large media exports."""
