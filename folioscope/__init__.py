"""folioscope: a Spark-native analytics engine for documentation corpora."""

__version__ = "0.1.0"
