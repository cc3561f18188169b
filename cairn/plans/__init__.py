"""Composite plans and the catalog of named queries."""
