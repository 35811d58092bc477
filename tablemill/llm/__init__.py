"""Training-data operators: dedup, filtering, tokenisation and mixing at corpus scale."""
