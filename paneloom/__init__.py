"""Entity x quarter panels, text features, mention networks and model comparison on Spark."""

__version__ = "0.1.0"
