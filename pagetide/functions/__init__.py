"""Column functions: text, URLs, HTML, feeds."""
