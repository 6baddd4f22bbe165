"""Distributed building blocks: scratch tables, exact quantiles, ranks, ordered sequences."""
