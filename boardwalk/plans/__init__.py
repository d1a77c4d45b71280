"""Composed flows: extraction routes and the full run."""
