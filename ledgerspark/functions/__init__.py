"""Column expressions: cleaning, features, scores."""
