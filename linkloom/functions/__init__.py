"""Column expressions: text, HTML and URLs."""
