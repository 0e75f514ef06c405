"""Join, ranking and vector operators as DataFrame functions."""
