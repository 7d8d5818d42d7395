"""loomgraph: Spark-native analytics over versioned property graphs of source code."""

__version__ = "0.1.0"
