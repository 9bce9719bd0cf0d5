"""Names and orders of the data model's enumerations, and limits that change answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Enumerations in the order that sorting follows.
ROLES = ["source", "document", "symbol", "test", "entrypoint", "configuration", "generated", "archived"]
CERTAINTIES = ["known", "dynamic", "unknown", "missing-target"]
RELATIONSHIPS = ["dependency", "implementation", "replacement", "supersedes", "validation", "reachability", "conflict", "backlink", "consumer"]
POSITIVE_RELATIONSHIPS = ["dependency", "implementation", "replacement", "supersedes", "validation", "reachability"]
PRIORITIES = ["required", "recommended", "related"]

# Weights and limits of fielded ranking.
FIELDS = ["filename", "path", "body", "description"]
FIELD_WEIGHTS = [3.0, 1.0, 1.0, 1.5]
LENGTH_NORMALIZATION = [0.2, 0.2, 0.75, 0.6]
K1 = 1.2
TRAIT_WEIGHT = 0.5 / 400.0
TEST_ROLE_WEIGHT = 4.0
REFERENCE_SUPPORT = 0.4
REFERENCE_TRANSFER = 0.75
VALUE_PEAK_SHARE = 0.25
SCHEDULE_PEAK_SHARE = 0.5
SCORE_SCALE = 1_000_000
SCORE_OFFSET = 1_000
SHORTLIST = 32
RULE_SHARE = (3, 10)
BRIEF_TOP = 8
BRIEF_CHARS = 2_000
BRIEF_CHARS_PER_EXTRA = 250

# Bounds of views, packets, scans and evidence.
MAX_FILES, MAX_FILE_BYTES, MAX_TOTAL_BYTES = 10_000, 1 << 20, 256 << 20
MAX_VIEW_ITEMS, MAX_VIEW_BYTES, MAX_NODE_IDS, MAX_SOURCE_ROLES, MAX_VIEW_FIELDS, MAX_FILTER_DEPTH, MAX_FILTER_CLAUSES = 4_096, 1_048_576, 256, 16, 64, 16, 128
MAX_EVIDENCE_RECORDS = 32
FREQUENCY_CAP = 500
MAX_SYMBOL_EVIDENCE = 64


def ordinal(column: Column, names: list[str]) -> Column:
    """The place of a name in its enumeration, from 0; null for others."""
    place = F.array_position(F.array(*map(F.lit, names)), column)
    return F.when(place > 0, (place - 1).cast("int"))
