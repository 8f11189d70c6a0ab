"""Feature engineering over per-entity event streams, expressed as Spark plans."""

__version__ = "0.1.0"
