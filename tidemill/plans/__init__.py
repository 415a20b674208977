"""Registered queries by kind; each module has QUERIES and SQL."""
