"""What is to be done: specifications, types, watermarks."""
