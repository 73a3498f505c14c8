"""kerbline: a PySpark engine for time-aware road-network risk and corpus preparation."""

__version__ = "0.1.0"
