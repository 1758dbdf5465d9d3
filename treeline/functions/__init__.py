"""Type predicates: on single values of documents, and as columns."""
