"""The queries a user asks for. Each takes DataFrames and an explicit as_of and returns a DataFrame."""
