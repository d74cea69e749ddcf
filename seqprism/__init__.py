"""Discriminative analysis of labelled sequences on Spark DataFrames."""
