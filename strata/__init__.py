"""strata: versioned, keyed datasets on Spark."""

__version__ = "0.1.0"
