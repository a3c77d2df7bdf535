"""Derived matrices over the tables, and the registered queries."""
