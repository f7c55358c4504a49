"""Declarative queries that become pruned plans."""
