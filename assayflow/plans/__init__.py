"""Fixture views, registered queries and end-to-end jobs."""
