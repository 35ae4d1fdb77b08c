"""Operators of a training-data pipeline over ``documents``; nothing outside this folder and ``corpus_pipeline.py`` imports it."""
