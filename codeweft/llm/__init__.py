"""Operators on source text and prose for building training data. Nothing outside this folder imports it."""
