"""Operators for preparing text, code and vector collections at scale."""
