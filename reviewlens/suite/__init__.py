"""All registered queries and their checks."""

from reviewlens.suite import boards, bundle, reconciliation, reviews, streams, tables, texts, zones  # noqa: F401
from reviewlens.suite.registry import CHECKS, QUERIES, check_sql, runner  # noqa: F401
