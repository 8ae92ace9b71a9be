"""All queries by name, with the SQL that tells their result."""

from __future__ import annotations

from labelloom.plans import cleaning, curation, evaluation, knowledge, markers, more, records, sparse, tabled, transfers  # noqa: F401  each module registers its queries
from labelloom.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "E3_balanced_selection"
