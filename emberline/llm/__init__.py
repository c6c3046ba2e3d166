"""Training-data operators: dedup, packing, extraction, filtering, mixing,
similarity joins, vector search and chat formatting. Nothing outside this
subpackage imports it."""
