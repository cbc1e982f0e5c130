"""Claim and evidence analytics for news-like text on Spark."""
