"""Column functions: hostname-like artifacts, release fields, vectors."""
