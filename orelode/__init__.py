"""Commodity-mining feed monitoring, web portfolio extraction and market analytics on Spark.

Every operator is a function from DataFrames to a DataFrame; nothing here starts a
job except the sinks and the streaming starters.
"""

__version__ = "0.1.0"
