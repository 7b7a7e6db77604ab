"""Column functions: ids, text, vectors, geo, redaction, sealing and labels."""
