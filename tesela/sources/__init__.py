"""sources of tesela."""
