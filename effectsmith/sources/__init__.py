"""Readers and writers of the study's tables."""
