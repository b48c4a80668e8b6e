"""Training-data pipeline operators (ten numbered operators and their queries)."""
