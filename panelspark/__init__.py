"""panelspark: Spark jobs for wide, era-bucketed panel tables."""

__version__ = "0.1.0"
