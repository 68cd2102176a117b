"""One function per operator: DataFrames and options in, a DataFrame out."""
