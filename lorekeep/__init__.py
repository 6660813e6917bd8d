"""A PySpark-native analytics engine for long-lived, versioned text memory."""

__version__ = "0.1.0"
