"""Operators for building training data from large document corpora. Nothing else in the library imports this subpackage."""
