"""Column expressions: text, URLs, patterns, networks, bins and numbers."""
