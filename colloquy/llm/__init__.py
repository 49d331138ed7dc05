"""Operators for building language-model training data, each a DataFrame-to-DataFrame function."""
