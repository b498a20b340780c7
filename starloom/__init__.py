"""A profile-driven warehouse engine on PySpark: YAML profiles in, a star schema out."""

from .plans.profile import DatasetProfile, discover_profiles, load_profile

__all__ = ["DatasetProfile", "discover_profiles", "load_profile"]
