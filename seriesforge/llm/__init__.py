"""Operators for preparing training data: text, tokens, near copies, archives and vectors."""
