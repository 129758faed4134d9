"""streaming of textloom."""
