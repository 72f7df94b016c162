"""fossilframe: quantitative palaeontology and ecology on Spark DataFrames."""
