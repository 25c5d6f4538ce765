"""Every query of the library by name, with SQL that says the same."""

from __future__ import annotations

from . import analytics, answers, assembly, corpus, events, graph, knowledge, ontology, replies, retrieval, rules, service
from .base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "analytics", "answers", "assembly", "corpus", "events", "graph", "knowledge", "ontology", "replies", "retrieval", "rules", "service"]
