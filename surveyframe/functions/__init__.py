"""Column expressions: cleaning, distributions, intervals and publication rules."""
