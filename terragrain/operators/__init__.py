"""Relational building blocks of gridding: filters, stencil, aggregation, fills, bins, blocks."""
