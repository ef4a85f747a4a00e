"""Operators for preparing training text: tokens, shards, language models, copies, rules, archives."""
