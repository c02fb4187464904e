"""clausewise.functions."""
