"""Training-data operators: dedup, language, tokens, archives, quality, secrets, media.

Nothing outside this subpackage imports it.
"""
