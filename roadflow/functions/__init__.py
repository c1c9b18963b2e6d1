"""Functions of the road-network engine."""
