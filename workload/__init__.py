"""Registered queries: a Spark function and its SQL oracle side by side."""
