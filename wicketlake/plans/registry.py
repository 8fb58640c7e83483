"""The list of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from wicketlake.sources import star


@dataclass(frozen=True)
class Entry:
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def register(key: str, sql: str | None = None):
    def add(build: Callable[[SparkSession, str], DataFrame]):
        if key in ENTRIES:
            raise ValueError(f"duplicate query {key}")
        ENTRIES[key] = Entry(build, sql)
        return build

    return add


def over_deliveries(select: str, more: str = "") -> str:
    """A check query over the delivery table; ``more`` adds common table expressions."""
    return f"WITH deliveries AS ({star.delivery_source_sql()}){', ' + more if more else ''} {select}"


def over_questions(select: str, more: str = "") -> str:
    return f"WITH questions AS ({star.question_source_sql()}){', ' + more if more else ''} {select}"
