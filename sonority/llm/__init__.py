"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; each module holds one operator and
:mod:`sonority.llm.queries` registers them.
"""
