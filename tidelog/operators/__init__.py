"""Reusable DataFrame operators: assembly, paging, exact quantiles, interval lookup."""
