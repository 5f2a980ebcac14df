"""Stateless operators on unbounded input."""
