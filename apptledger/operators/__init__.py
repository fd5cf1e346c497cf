"""Transforms over the domain tables."""
