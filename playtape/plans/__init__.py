"""Domain plans composed from the operators and functions."""
