"""clausewise.plans."""
