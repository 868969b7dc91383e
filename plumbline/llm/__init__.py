"""Training-data operators: quality, secrets, tokens, near duplicates, decontamination, URLs and pages."""
