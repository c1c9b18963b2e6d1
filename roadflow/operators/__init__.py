"""Operators of the road-network engine."""
