"""Column functions: names with dots, text terms, facet labels."""
