"""chunkyard: source-code and document retrieval analytics on Spark DataFrames."""
