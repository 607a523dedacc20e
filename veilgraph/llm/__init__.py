"""Training-data operators: dedup, extraction, tokenisation, decontamination and scoring."""
