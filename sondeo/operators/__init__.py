"""The analysis operators; each takes a DataFrame (or an ordered sequence) and returns a small DataFrame."""
