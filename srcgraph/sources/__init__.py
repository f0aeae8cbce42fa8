"""Readers: files, archives, graph documents, project configs, snapshots, logs."""
