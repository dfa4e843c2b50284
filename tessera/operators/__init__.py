"""Operators: pure DataFrame-to-DataFrame functions over the cell log and its views."""
