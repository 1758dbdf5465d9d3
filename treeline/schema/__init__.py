"""Schema language: text to statements, statements to an expanded schema."""
