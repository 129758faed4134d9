"""textloom: web-corpus analytics on Spark."""
