"""Manifests, inventory scans and the stored index."""
