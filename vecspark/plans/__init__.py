"""Filters and the choice of a search strategy."""
