"""Column functions: text, rates, similarity and question rules."""
