"""Bindings of the operators to the given tables, each with its SQL where SQL can say the same."""
