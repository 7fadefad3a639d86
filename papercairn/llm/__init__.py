"""Operators that prepare text and vectors of papers for training language models."""
