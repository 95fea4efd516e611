"""Operators for preparing training data: packing, filters, codecs, joins, searches.

Each module is one operator. Nothing outside this folder imports it. Every
operator takes and returns DataFrames and documents what nulls, empty texts,
ties, repeated rows and empty tables give.
"""
