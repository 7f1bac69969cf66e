"""Document retrieval, corpus analysis and training-data preparation on Spark."""
