"""Training-data operators: dedup, filtering, tokenisation, archives, search and decontamination."""
