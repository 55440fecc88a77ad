"""functions of tesela."""
