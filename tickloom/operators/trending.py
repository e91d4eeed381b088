"""Trending terms per window, exact, from mergeable summaries; spread of sentiment and engagement."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.math import safe_divide
from tickloom.functions.text import NEGATIVE_WORDS, POSITIVE_WORDS, text_sentiment

#: Runs of letters, digits and underscores, with a leading # or $ where there is one.
TERM = r"[#$]?[\p{L}\p{N}_]+"


class Summary:
    """Misra-Gries counters: every item with more than n / (size + 1) of n occurrences is among them.

    An item that finds no counter lowers them all; two summaries merge by adding their counters and
    lowering all by the (size + 1)-th largest, which keeps the promise.
    """

    def __init__(self, size: int):
        self.size, self.counts = size, {}

    def add(self, item: str, n: int = 1) -> None:
        counts = self.counts
        if item in counts or len(counts) < self.size:
            counts[item] = counts.get(item, 0) + n
            return
        down = min(n, min(counts.values()))
        self.counts = counts = {k: v - down for k, v in counts.items() if v > down}
        if n > down:
            self.add(item, n - down)

    def merge(self, other: Summary) -> None:
        for item, n in other.counts.items():
            self.counts[item] = self.counts.get(item, 0) + n
        if len(self.counts) > self.size:
            down = sorted(self.counts.values(), reverse=True)[self.size]
            self.counts = {k: v - down for k, v in self.counts.items() if v > down}


def term_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def candidates(terms: DataFrame, share: float) -> DataFrame:
    """(window, term): all terms that can have `share` of a window's terms, a summary of each task's rows and window.

    A term with the share in the window has it in the rows of at least one task, so it is in that task's
    summary of 1 / share counters. The window's tasks send no more than these.
    """
    size = math.ceil(1 / share)
    schema = pa.schema([("window", pa.string()), ("term", pa.string())])

    def summed_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str | None, Summary] = {}
        for batch in batches:
            for window, words in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = held.get(window)
                if own is None:
                    own = held[window] = Summary(size)
                for word in words or ():
                    own.add(word)
        for window, summary in held.items():
            if summary.counts:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([window] * len(summary.counts), pa.string()), pa.array(list(summary.counts), pa.string())], schema=schema)

    return terms.select("window", "terms").mapInArrow(summed_up, "window string, term string").distinct()


def trending_terms(messages: DataFrame, window: Column, text: str = "text", share: float = 0.01, best: int = 20) -> DataFrame:
    """window (as text), term, n, share, rank: the terms with at least `share` of all terms of their window, `best` at most.

    A first pass gathers candidates in bounded summaries, a second counts just those, exactly; so no task
    holds all terms of a window. Terms are lower-cased runs of letters, digits and _, with a leading # or $.
    Order: n, then the term. A NULL window is one like any other; a NULL text has no terms.
    """
    terms = messages.select(window.cast("string").alias("window"), term_list(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
    found = candidates(terms, share).select(F.struct("window", "term").alias("_c"))
    total = terms.groupBy("window").agg(F.sum(F.size("terms")).alias("_all"))
    each = terms.select("window", F.explode("terms").alias("term"))
    counted = each.join(found, F.struct("window", "term").eqNullSafe(F.col("_c")), "left_semi").groupBy("window", "term").agg(
        F.count(F.lit(1)).alias("n"))
    named = total.select(F.col("window").alias("_w"), "_all")
    rated = counted.join(named, F.col("window").eqNullSafe(F.col("_w"))).withColumn("share", F.col("n") / F.col("_all")).where(
        F.col("share") >= share)
    order = Window.partitionBy("window").orderBy(F.desc("n"), "term")
    return rated.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best).select("window", "term", "n", "share", "rank")


def sentiment_spread(messages: DataFrame, by: Sequence[str], answered: Column, positive: Sequence[str] = POSITIVE_WORDS,
                     negative: Sequence[str] = NEGATIVE_WORDS) -> DataFrame:
    """Mean and sample deviation of the lexicon sentiment per group, and engagement: answers per message that is none."""
    scored = messages.select(*by, text_sentiment("text", positive, negative).alias("_s"), F.coalesce(answered, F.lit(False)).alias("_a"))
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("messages"), F.avg("_s").alias("sentiment"), F.stddev_samp("_s").alias("sentiment_volatility"),
        safe_divide(F.count_if("_a"), F.count_if(~F.col("_a"))).alias("engagement_rate"))
