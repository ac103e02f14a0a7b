"""Relational operators over documents, chunks, queries and hits."""
