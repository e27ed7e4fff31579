"""Operators for preparing training text: quality, language, duplicates, links, packing, leaks, toxicity, ids, pages."""
