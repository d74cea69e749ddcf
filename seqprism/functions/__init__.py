"""Column expressions over sequences and scores."""
