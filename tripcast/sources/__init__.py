"""Readers and writers of trip, prediction and result tables."""
