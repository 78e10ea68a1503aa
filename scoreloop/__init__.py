"""scoreloop: Spark-native data loop around a tabular regression model."""

__version__ = "0.1.0"
