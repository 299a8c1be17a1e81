"""Binding of the operators to the driver tables, with SQL oracles."""
