"""streaming of inkgrid."""
