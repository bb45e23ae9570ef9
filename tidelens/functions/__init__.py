"""Column-level building blocks: null-safe arithmetic, rolling frames, special functions."""
