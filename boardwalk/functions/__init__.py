"""Column expressions: text, URLs, page nodes and fixed values."""
