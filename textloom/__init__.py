"""textloom: explainable text-overlap analytics on Spark DataFrames."""
