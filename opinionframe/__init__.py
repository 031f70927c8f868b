"""opinionframe: a PySpark-native analytics engine for opinion data."""

__version__ = "0.1.0"
