"""emberline.streaming."""
