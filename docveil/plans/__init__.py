"""Queries over the catalog tables, and the SQL each is checked against."""
