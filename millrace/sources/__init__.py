"""Readers, writers, row generators and the star-schema datasets."""
