"""Column-level building blocks: calendar arithmetic, rates, medians, tail probabilities."""
