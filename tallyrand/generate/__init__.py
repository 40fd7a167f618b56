"""Seeded generators of populations, structure and event histories."""
