"""Queries over the driver's tables, one module for each part of the engine."""

from lexspan.catalog import aggregates, algebra, evaluation, feedback, ingest, retrieval, updates

__all__ = ["aggregates", "algebra", "evaluation", "feedback", "ingest", "retrieval", "updates"]
