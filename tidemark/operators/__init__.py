"""Exact operators on measurements."""
