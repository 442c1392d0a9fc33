"""Public-register analytics as Spark jobs.

Landed register files become DataFrames of ragged rows, rows become dated
snapshots, and snapshots become column-level change events that a watchlist can
be matched against.  Everything is DataFrame / SQL / Structured Streaming code.
"""

__version__ = "0.1.0"
