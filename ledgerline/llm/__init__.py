"""Training-data operators: quality, extraction, archives, de-duplication, language, privacy and mixing."""
