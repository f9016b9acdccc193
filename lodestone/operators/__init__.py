"""Operators from file tables to fact tables, and relational operators over the facts."""
