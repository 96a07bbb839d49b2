"""gridloom: a PySpark-native analytics engine for gridded, multi-track satellite time series."""

__version__ = "0.1.0"
