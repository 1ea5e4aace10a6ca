"""Chains of operators with the tables they write."""
