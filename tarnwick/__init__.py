"""tarnwick: a PySpark-native engine for curating, auditing and scoring multi-source measurement tables."""

__version__ = "0.1.0"
