"""Registered queries: operators over the test tables, with SQL twins."""
