"""Preparation of training text: scoring, deduplication, cleaning, mixing and token output."""
