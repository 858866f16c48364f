"""Composed flows: several operators declared as one plan."""
