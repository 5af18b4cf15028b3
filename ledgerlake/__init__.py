"""Personal-spend analytics as DataFrame transforms."""
