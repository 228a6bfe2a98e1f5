"""Registered queries: catalog reports and operators over carrier tables, with DuckDB counterparts."""
