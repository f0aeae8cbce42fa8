"""DataFrame operators: extraction, resolution, graph build and graph analytics."""
