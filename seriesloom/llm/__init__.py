"""Operators for preparing language-model training data (numbered op1 .. op10)."""
