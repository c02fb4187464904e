"""clausewise.streaming."""
