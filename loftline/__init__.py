"""loftline: shot-tracking, round-history and course-map analytics as Spark jobs."""

from loftline.session import build_session
from loftline.settings import DEFAULTS, Settings

__all__ = ["DEFAULTS", "Settings", "build_session"]
