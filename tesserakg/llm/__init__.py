"""Operators for the texts, names and vectors of training data; nothing outside this subpackage needs it."""
