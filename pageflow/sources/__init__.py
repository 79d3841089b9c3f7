"""Readers and writers: page snapshots, binary files, robots/sitemaps, partitioned sinks."""
