"""Dataflow operators: text to tables, tables to findings."""
