"""Whole plans: enrichment and token estimation."""
