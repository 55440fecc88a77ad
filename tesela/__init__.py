"""tesela: a PySpark-native engine for territorial demand analytics and data preparation."""

__version__ = "0.1.0"
