"""Readers of source trees, logs, manifests and event files; writers of results."""
