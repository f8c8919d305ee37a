"""Table operators. Every function takes DataFrames and returns DataFrames."""
