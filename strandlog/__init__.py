"""strandlog: a Spark-native append-only event log with composable queries and kept state."""

__version__ = "0.1.0"
