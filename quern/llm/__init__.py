"""Corpus preparation for language-model training: thirteen operators, their queries and SQL.

Nothing else in the library imports this subpackage.
"""
