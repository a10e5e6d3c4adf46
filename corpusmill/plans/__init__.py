"""Registered queries over the test tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from corpusmill.plans import chat, corpus, evaluation, files, retrieval

QUERIES = corpus.QUERIES | retrieval.QUERIES | evaluation.QUERIES | chat.QUERIES | files.QUERIES
ORACLE_SQL = corpus.ORACLE_SQL | retrieval.ORACLE_SQL | evaluation.ORACLE_SQL | chat.ORACLE_SQL | files.ORACLE_SQL
