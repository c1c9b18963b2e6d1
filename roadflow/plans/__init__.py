"""Plans of the road-network engine."""
