"""operators of tesela."""
