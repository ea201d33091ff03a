"""DataFrame operators: extraction, resolution, graph, components, risks, diff, views."""
