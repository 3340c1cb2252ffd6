"""Profile tables of any size on Spark."""

from tallygrid.grid import Grid, grid
from tallygrid.options import ProfileOptions, parse_tokens
from tallygrid.plans.profile import Profile, profile

__all__ = ["Grid", "Profile", "ProfileOptions", "grid", "parse_tokens", "profile"]
