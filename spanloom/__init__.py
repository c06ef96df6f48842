"""spanloom: observability analytics over span, metric and log tables on Spark."""

__version__ = "0.1.0"
