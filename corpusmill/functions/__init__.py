"""Column functions: text normalisation, citations, vectors."""
