"""Tables to read."""
