"""Operators of a training-data pipeline: deduplication, extraction,
language, secrets, mixing, decontamination, token counts and scoring."""
