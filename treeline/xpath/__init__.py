"""Path expressions: syntax, evaluation on documents, and compilation to columns."""
