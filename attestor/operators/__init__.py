"""Relational operators of the claim and evidence analysis."""
