"""Column functions: text, dialogue messages, keys, URLs and model replies."""
