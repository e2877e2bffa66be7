"""Readers, writers and a generated corpus."""
