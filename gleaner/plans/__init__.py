"""Registered queries of the core engine."""
