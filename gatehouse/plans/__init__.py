"""Versioned tables and checks on executed plans."""
