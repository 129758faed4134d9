"""Writers of textloom: collections, reports, vectors, snapshots."""
