"""Tessellum: license and provenance analytics over large text corpora, built on Spark DataFrames."""
