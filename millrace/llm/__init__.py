"""Training-data operators: language ID, tokens, near-duplicates, scoring, secrets, mixing and URL rules.

Nothing outside this subpackage imports it.  ``catalog`` lists its queries and their SQL.
"""
