"""lettermill: retrieval, analytics and text-mining operators for message-like corpora, declared on Spark DataFrames."""
