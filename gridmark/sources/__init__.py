"""Readers and writers: annotation files, label text, media listings, manifests, metrics, shards and result records."""
