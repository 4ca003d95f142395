"""Table operators: DataFrames in, a DataFrame out."""
