"""Registered queries of the phonotactic operators, with their SQL."""

from __future__ import annotations

from sonority.jobs import corpus, folds, grammars, lexicons, masses

QUERIES: dict = corpus.QUERIES | grammars.QUERIES | folds.QUERIES | lexicons.QUERIES | masses.QUERIES
SQL: dict = corpus.SQL | grammars.SQL | folds.SQL | lexicons.SQL | masses.SQL
