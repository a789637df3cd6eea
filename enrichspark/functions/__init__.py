"""Column-level building blocks: exact tests, hash draws, text normalisation, bins."""
