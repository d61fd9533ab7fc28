"""Shared shapes of plans: statistics back onto rows, two-sample moments, exact quantiles."""
