"""Drafts of profiles from raw files."""
