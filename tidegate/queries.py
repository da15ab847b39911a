"""Registry of the inspection queries and their oracle SQL."""

from tidegate.suites import evasion, texts, traffic  # noqa: F401
from tidegate.suites.common import ORACLE, QUERIES  # noqa: F401
