"""All registered queries."""

from suite import queries_models, queries_reports, queries_text, queries_web  # noqa: F401
from suite.catalog import QUERIES  # noqa: F401
