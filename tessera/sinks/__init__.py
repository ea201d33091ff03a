"""Exports: JSON, Mermaid, Cytoscape elements, tables, HTTP."""
