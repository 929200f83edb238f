"""Registered queries. Importing this package registers all of them."""

from docledger.plans import changes, extraction, queries, reporting, rules  # noqa: F401
from docledger.plans.registry import ORACLE, QUERIES  # noqa: F401
