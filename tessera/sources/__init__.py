"""Readers and writers, and the fixture graph over relational tables."""
