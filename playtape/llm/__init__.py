"""Operators for preparing training text: quality, language, toxicity, licences, duplicates, leaks, shards, chat, tokens."""
