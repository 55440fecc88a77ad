"""streaming of tesela."""
