"""Where tables land."""
