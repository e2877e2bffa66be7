"""Operators wired into whole runs."""
