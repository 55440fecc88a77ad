"""plans of tesela."""
