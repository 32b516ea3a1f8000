"""Column functions: text classification, extraction, normalisation, JSON text."""
