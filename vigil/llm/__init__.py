"""Operators of a training-data pipeline: tokenisation, sharding, dedup,
decontamination, WARC archives, URL filters, language ID and PII surrogates.

Nothing else in the library imports this subpackage.
"""
