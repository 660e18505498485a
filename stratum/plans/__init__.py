"""Registered queries, by group, and the SQL that checks them."""
