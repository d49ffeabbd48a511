"""graphlens: analytics over software and infrastructure graphs, on Spark DataFrames."""

__version__ = "0.1.0"
