"""emberline.functions."""
