"""Whole jobs and the registered queries with their SQL counterparts."""
