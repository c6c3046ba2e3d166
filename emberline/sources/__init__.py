"""emberline.sources."""
