"""Registered plans: one Spark query per operator and its SQL twin."""
