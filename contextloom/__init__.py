"""Document, retrieval and task analytics on Spark DataFrames."""
