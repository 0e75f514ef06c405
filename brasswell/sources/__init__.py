"""Readers of inputs and tables in the shared folder."""
