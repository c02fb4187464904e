"""clausewise.operators."""
