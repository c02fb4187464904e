"""clausewise.sources."""
