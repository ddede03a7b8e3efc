"""Seeded synthesis: schemas, graph data, query templates."""
