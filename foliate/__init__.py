"""Foliate: structured queries and edits over document-shaped data, on Spark DataFrames."""
