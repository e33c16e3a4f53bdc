"""Operators for training data. Optional: nothing outside this folder imports it."""
