"""Composite plans, fixtures and registered queries."""
