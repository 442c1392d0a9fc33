"""Verbs over register rows.  Each takes and returns DataFrames."""
