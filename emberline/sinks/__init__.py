"""emberline.sinks."""
