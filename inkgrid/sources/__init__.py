"""sources of inkgrid."""
