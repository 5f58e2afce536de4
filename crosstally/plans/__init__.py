"""Compositions of the operators: the pipeline on its own tables, and bindings to other tables."""
