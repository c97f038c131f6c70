"""Registered queries over the test tables, each with its reference SQL where one exists."""
