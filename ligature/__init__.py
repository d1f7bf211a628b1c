"""Record linkage, entity resolution and corpus processing on Spark DataFrames."""
