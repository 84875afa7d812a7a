"""Literature-gap discovery on concept co-occurrence graphs, as Spark DataFrames."""

__version__ = "0.1.0"
