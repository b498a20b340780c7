"""Readers of raw data."""
