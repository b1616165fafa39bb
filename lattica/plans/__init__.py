"""Helpers that shape plans: reading tables, cutting lineage, checked broadcasts."""
