"""Training-data operators over text, page and vector tables."""
