"""Readers of questions, manifests, settings and features, and guards on them."""
