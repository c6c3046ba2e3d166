"""emberline.operators."""
