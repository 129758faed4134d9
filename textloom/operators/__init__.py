"""operators of textloom."""
