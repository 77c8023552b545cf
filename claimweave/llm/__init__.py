"""Training-data operators: tokenised output, tokenisation, filtering, search, dedup, scoring, sharding.

Each module holds one operator as DataFrame -> DataFrame functions; ``queries.py`` holds the thin
registered queries.  Nothing outside this subpackage imports it.
"""
