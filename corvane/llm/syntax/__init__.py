"""Syntax of the languages of the files table."""
