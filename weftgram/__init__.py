"""Pattern analytics on Spark DataFrames: mining, graphs, alignment, search."""

__version__ = "0.1.0"
