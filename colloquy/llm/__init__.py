"""Operators for building training corpora: filters, extraction, joins, mixing and packing.

Nothing else in the library imports this subpackage.  Each module holds one operator with a general
interface; :mod:`colloquy.llm.queries` registers the thin ``opN_<name>`` queries on top of them.
"""
