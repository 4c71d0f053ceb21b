"""functions of inkgrid."""
