"""Operations that a large training-data pipeline needs, one module for each.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
