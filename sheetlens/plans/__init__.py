"""Whole-table analyses made of the operators, and the registered queries."""
