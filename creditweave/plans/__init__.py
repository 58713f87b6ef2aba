"""Whole jobs: matching, extraction, posting, evaluation, reporting."""
