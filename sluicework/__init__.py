"""Spark jobs that audit, score and govern question-answering data and model outputs."""
