"""weft: relational, text, vector, graph and spatial analytics over Spark DataFrames."""
