"""Registered queries over the given tables, and the SQL that says what they must return."""
