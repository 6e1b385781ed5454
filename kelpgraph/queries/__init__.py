"""Registered queries of the graph engine and the SQL each is checked against."""
