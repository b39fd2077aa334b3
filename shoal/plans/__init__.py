"""Session skeleton, shared-folder tables and plan lineage."""
