"""Compositions of operators: baselines, selection of a champion, blends and fitted models."""
