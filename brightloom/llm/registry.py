"""Every training-data query by name, with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from brightloom.llm import (
    chat_format,
    decontaminate,
    exact_dedup,
    fingerprint_search,
    langid,
    license_scan,
    line_dedup,
    mixing,
    simhash,
    spelling,
    substring_dedup,
    token_align,
    url_filter,
)

MODULES = (chat_format, substring_dedup, decontaminate, mixing, url_filter, line_dedup, simhash, exact_dedup, license_scan, langid, spelling, fingerprint_search, token_align)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
