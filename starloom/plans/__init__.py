"""Profiles, the clean plan, the warehouse build and its artefacts."""
