"""Registered queries and their SQL, by group."""
