"""Functions that return Columns."""
