"""Spark ML jobs: classifiers with their grids, ensembles, model selection, persistence."""
