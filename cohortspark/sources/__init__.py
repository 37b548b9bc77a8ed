"""Readers and the projection of star-schema tables onto the health schema."""
