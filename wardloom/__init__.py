"""wardloom: screening, sanitising and auditing of language-model traffic on Spark DataFrames."""

__version__ = "0.1.0"
