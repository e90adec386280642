"""The job of the last days: each day with data is one batch of its own, extracted, brought under the rules and loaded."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import ConditionError
from ..sources.tables import extract
from .load import COUNTS, Store, run

log = logging.getLogger(__name__)
DONE, FAILED, MISUSED = 0, 1, 2  # exit codes


@dataclass
class Days:
    """What a job did: its exit code, the counts of each day it loaded, the days that were there already, and what stopped it."""

    code: int = DONE
    loaded: dict[date, dict[str, int]] = field(default_factory=dict)
    skipped: list[date] = field(default_factory=list)
    seconds: float = 0.0
    problem: str = ""

    def total(self) -> dict[str, int]:
        return {c: sum(x[c] for x in self.loaded.values()) for c in COUNTS}

    def summary(self) -> str:
        t = self.total()
        text = f"{len(self.loaded)} days loaded, {len(self.skipped)} there already: {t['rows_in']} rows, {t['points_new']} new points, {t['points_changed']} changed, {t['averaged']} cells averaged"
        return f"{text}; {self.seconds:.1f} s" + (f"; {self.problem}" if self.problem else "")


def days_with_data(rows: DataFrame) -> dict[date, int]:
    """The days of an extraction and their rows; of data laid out by day, no column but those of the conditions is read."""
    day = F.col("day") if "day" in rows.columns else F.to_date("ts")
    return {r.day: r.n for r in rows.groupBy(day.alias("day")).agg(F.count("*").alias("n")).collect()}  # a row a day


def run_days(
    source: DataFrame, target: Store, line: str, days: int = 1, today: date | None = None,
    rules: Callable[[DataFrame], DataFrame] = lambda df: df, items: list[str] | None = None, where: Column | None = None,
) -> Days:
    """Loads the last `days` days, today included, one batch a day in order. Never raises: a scheduler reads the code.

    A day's batch is named by line, day and number of rows, so a day that is in the store already is skipped, one
    that got more rows since is merged again, and after a crash the next run goes on with the day that was lost.
    Codes: 0 for done, 1 for a failure or no data at all, 2 for a missing line or no days to load.
    """
    began, out = time.monotonic(), Days()
    last = today or date.today()
    first = last - timedelta(days=days - 1)
    try:
        if days < 1:
            raise ConditionError("days: one day or more")
        found = days_with_data(extract(source, line, str(first), str(last), items, where))
        if not found:
            out.code, out.problem = FAILED, f"no data from {first} to {last}"
        there = target.batches_loaded() if found else set()
        for day, n in sorted(found.items()):
            batch = f"{line}/{day}/{n}"
            counts = None if batch in there else run(source, target, batch, line, str(day), str(day), rules, items, where)
            if counts is None:
                out.skipped.append(day)
            else:
                out.loaded[day] = counts
                log.info("%s: %s", day, counts)
    except ConditionError as error:
        out.code, out.problem = MISUSED, str(error)
    except Exception as error:  # what was loaded before stays
        log.exception("the job stopped")
        out.code, out.problem = FAILED, f"{type(error).__name__}: {str(error).splitlines()[0] if str(error) else ''}"
    out.seconds = time.monotonic() - began
    log.info(out.summary())
    return out
