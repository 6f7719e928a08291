"""granary: an ingestion and hybrid-retrieval engine written for Spark DataFrames."""
