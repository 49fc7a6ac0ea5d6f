"""The queries of this folder and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm.p1_plain_form import p1_found, p1_plain
from quillmesh.llm.p2_overlaps import p2_found, p2_report
from quillmesh.llm.p3_personal import p3_found, p3_redacted
from quillmesh.llm.p4_neighbours import p4_found, p4_neighbours, p4_search
from quillmesh.llm.p5_families import p5_found
from quillmesh.llm.p6_splits import p6_found, p6_splits
from quillmesh.llm.p7_languages import p7_found, p7_languages, p7_stretches
from quillmesh.llm.p8_encode import p8_ids
from quillmesh.llm.p9_leaks import p9_found, p9_overlaps
from quillmesh.llm.p10_repetition import p10_found, p10_share


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_plain": p1_plain, "p2_found": p2_found, "p2_report": p2_report, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_search": p4_search, "p5_found": p5_found, "p6_found": p6_found, "p6_splits": p6_splits, "p7_found": p7_found, "p7_languages": p7_languages, "p7_stretches": p7_stretches, "p8_ids": p8_ids, "p9_found": p9_found, "p9_overlaps": p9_overlaps, "p10_found": p10_found, "p10_share": p10_share}


def oracle_sql() -> dict[str, str]:
    return {}
