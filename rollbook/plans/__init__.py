"""Whole jobs: the archive, ingest, and queries over the test tables."""
