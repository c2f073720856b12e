"""Sentence-pair corpora, concept vectors and their evaluation as Spark jobs."""
