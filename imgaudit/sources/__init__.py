"""Readers and writers of catalogs, manifests, feature tables and results."""
