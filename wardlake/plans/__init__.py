"""Composite jobs made of several operators, and the registered queries."""
