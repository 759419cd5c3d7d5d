"""Whole plans: linking and analysis."""
