"""Registered queries and the analysis plan."""
