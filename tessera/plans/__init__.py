"""Registered queries: Spark plans and their SQL counterparts."""
