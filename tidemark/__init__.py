"""Versioned content analytics on Spark: sources, chunking, diffs, lineage, search and catalog queries."""
