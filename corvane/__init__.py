"""Corvane: hybrid document retrieval and its evaluation on Spark DataFrames."""
