"""Operators for preparing training data: near-duplicates, chat rendering, packing, language
identification, byte-pair encoding, personal data, embeddings, token files, quality, secrets.

Nothing else in the library imports this subpackage.
"""
