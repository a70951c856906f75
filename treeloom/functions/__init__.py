"""Column functions: paths, text, numbers and in-row trees."""
