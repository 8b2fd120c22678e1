"""tessera: redundancy and disorder analytics for large file collections, on Spark DataFrames."""
