"""Writers: graph documents, snapshots, reports, audit lines."""
