"""Readers: catalog tables and document containers."""
