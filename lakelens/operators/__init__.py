"""Relational operators: search, chunking, catalog, gate, snapshot diff, flattening."""
