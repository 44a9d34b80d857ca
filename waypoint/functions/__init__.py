"""Column-level helpers (built-in Spark expressions only, no Python UDFs)."""

from waypoint.functions.kernel import *  # noqa: F401,F403
from waypoint.functions.tiers import *  # noqa: F401,F403
