"""Readers and writers of site, sequence, weight and motif files."""
