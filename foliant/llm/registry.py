"""The queries of the problems, by name. None has an SQL form: their rows come from models, automata and alignments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.chunks import p6_found, p6_pieces
from foliant.llm.language import p5_found
from foliant.llm.leaks import p8_found
from foliant.llm.lookalike import p2_found
from foliant.llm.names import p1_found
from foliant.llm.packing import p7_fill, p7_packed
from foliant.llm.scans import p4_found, p4_repaired
from foliant.llm.sentences import p3_found
from foliant.llm.subjects import p9_found

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_pieces": p6_pieces,
    "p7_packed": p7_packed,
    "p7_fill": p7_fill,
    "p8_found": p8_found,
    "p9_found": p9_found,
}

SQL: dict[str, str] = {}
