"""Operators over streams of tokens."""
