"""Registered queries: each applies operators to the driver's tables, with SQL that gives the same rows."""
