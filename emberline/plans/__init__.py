"""emberline.plans."""
