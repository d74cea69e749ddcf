"""Scoring of sequence streams."""
