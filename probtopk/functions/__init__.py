"""Column functions: distributions and boxes."""
