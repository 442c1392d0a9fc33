"""Change events as snapshots arrive."""
