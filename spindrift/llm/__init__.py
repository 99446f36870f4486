"""Training-data operators: dedup, archives, privacy, decontamination, toxicity, mixing, tokens, chat, extraction."""
