"""Operators on tables of rows, nodes, bags and leaves."""
