"""lakelens: retrieval, analytics and text operators on Spark DataFrames."""
