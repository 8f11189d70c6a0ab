"""Spec compilation and the query catalogue."""
