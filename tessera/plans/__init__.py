"""Queries: operators applied to the test data's tables, with the SQL they are held against."""
