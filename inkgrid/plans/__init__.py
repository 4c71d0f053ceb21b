"""plans of inkgrid."""
