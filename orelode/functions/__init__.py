"""Column functions: time, keys, text, URLs and HTML."""
