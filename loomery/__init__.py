"""Loomery: a Spark-first engine for building, splitting and scoring labelled-utterance corpora."""
