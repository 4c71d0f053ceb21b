"""operators of inkgrid."""
