"""Rising edges and changes with Spark's keyed state and a timer per key.

A key's state is a few numbers in the state store; a micro-batch reads and writes only the keys it holds.
Rows of one key of one micro-batch meet in one task, in Arrow batches; of those only what may still be
emitted is held, so the micro-batch (`maxFilesPerTrigger` and the like) bounds a hot key. A row passes
Python as one JSON text of its columns' texts, so whole numbers with NULLs, decimals and timestamps come
back as they were, and a key costs the conversion of a few columns, whatever the width of its rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, BinaryType, MapType, StructType, VariantType

from tickloom.operators.edges import payload_hash

#: Time of a row without one: before all others.
UNDATED = -(2**63)


def _row_as_text(schema: StructType) -> Column:
    columns = []
    for i, field in enumerate(schema.fields):
        if isinstance(field.dataType, (ArrayType, MapType, StructType, VariantType)):
            raise ValueError(f"keyed streams take plain columns, not {field.name}: {field.dataType.simpleString()}")
        col = F.col(f"`{field.name}`")
        columns.append((F.hex(col) if isinstance(field.dataType, BinaryType) else col.cast("string")).alias(f"c{i}"))
    return F.to_json(F.struct(*columns))


def _columns_from_text(rows: DataFrame, schema: StructType) -> DataFrame:
    texts = StructType()
    for i in range(len(schema.fields)):
        texts.add(f"c{i}", "string")
    # A column's text may be as long as it likes.
    held = rows.select(F.from_json("_row", texts, {"maxStringLen": str(2**31 - 1)}).alias("_r"))
    return held.select(*[(F.unhex(F.col(f"_r.c{i}")) if isinstance(f.dataType, BinaryType) else F.col(f"_r.c{i}").cast(f.dataType)).alias(f.name)
                         for i, f in enumerate(schema.fields)])


def _placed(ts: str, tie: str) -> list[Column]:
    return [F.coalesce(F.unix_micros(F.col(ts)), F.lit(UNDATED)).alias("_at"), F.coalesce(F.col(tie).cast("long"), F.lit(UNDATED)).alias("_tie")]


def _sortable(number: Column) -> Column:
    """16 hexadecimal digits in the order of the long."""
    return F.lpad(F.hex(number.bitwiseXOR(F.lit(UNDATED))), 16, "0")


#: Places in a row's text of `changed_rows`: time and number, then the hash of the compared columns, then T if the row passes.
HASH_FROM, HASH_TO = 32, 96


def _arm(state: GroupState, ttl_seconds: int | None) -> None:
    if ttl_seconds is not None:
        state.setTimeoutDuration(max(1, ttl_seconds * 1000))


def rising_edge_rows(ticks: DataFrame, high: Column, ttl_seconds: int | None = 1800, key: str = "token_id",
                     ts: str = "metric_time", tie: str = "metric_id") -> DataFrame:
    """Streaming rows that are high while their key was not high one row earlier.

    State of a key: time, `tie` (a whole number) and height of its newest row. A row older than that is
    late: it neither fires nor becomes the state, unless it is older by more than `ttl_seconds` (the
    stored row was dated in the future, or the clock was set back). A stored row more than `ttl_seconds`
    before a row does not count for it. A row without a time has no place: it neither fires nor becomes
    the state. The state of a key ends once the key has been idle for `ttl_seconds`, by the clock of the
    machine and by the newest time of the stream alike; None keeps it.
    """
    schema = ticks.schema
    # The column of the watermark goes along: without it the function could not ask for the stream's time.
    marked = ticks if ttl_seconds is None else ticks.withWatermark(ts, "0 seconds")
    clock = [] if ttl_seconds is None else [F.col(ts).alias("_time")]
    # Only a row that is high may be emitted and carries its text.
    line = F.concat_ws(" ", *[c.cast("string") for c in _placed(ts, tie)], F.when(high, _row_as_text(schema)))
    rows = marked.select(F.col(key).alias("_key"), line.alias("_line"), *clock)
    ttl = None if ttl_seconds is None else ttl_seconds * 1_000_000

    def edges(_key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = state.get[0]
            if state.getCurrentWatermarkMs() * 1000 >= at + ttl:
                state.remove()
            else:
                _arm(state, ttl_seconds)
            return
        seen = state.get if state.exists else None
        held = []
        for part in parts:
            for text in part["_line"].tolist():
                at, number, *row = text.split(" ", 2)
                place = int(at), int(number)
                late = seen is not None and place < seen[:2] and (ttl is None or seen[0] - place[0] <= ttl)
                if place[0] != UNDATED and not late:
                    held.append((place, row))
        if held:
            held.sort(key=lambda r: r[0])
            fired = []
            before, _, up = seen if seen is not None else (None, None, False)
            for (at, _), row in held:
                if row and not (up and (ttl is None or at - before <= ttl)):
                    fired += row
                before, up = at, bool(row)
            state.update((*held[-1][0], up))
            if fired:
                yield pd.DataFrame({"_row": fired})
        if state.exists:
            _arm(state, ttl_seconds)

    timeout = GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    fired = rows.groupBy("_key").applyInPandasWithState(edges, "_row string", "at long, tie long, high boolean", "append", timeout)
    return _columns_from_text(fired, schema)


def changed_rows(ticks: DataFrame, compared: Sequence[str | Column], passes: Column | None = None, key: str = "token_id",
                 order: Sequence[str] = ("metric_time", "metric_id"), ttl_seconds: int | None = None) -> DataFrame:
    """Streaming rows whose `compared` columns differ from the row last emitted for the key.

    Per micro-batch the newest row of a key by `order` (a time and a whole number) counts; if it does not
    pass, nothing is emitted and nothing remembered. Processing times are not compared, so an unchanged
    row stays silent. With `ttl_seconds` the state of a key that long idle by the machine's clock ends,
    and the key's next row is emitted.
    """
    schema = ticks.schema
    passed = F.lit(True) if passes is None else F.coalesce(passes, F.lit(False))
    line = F.concat(*[_sortable(c) for c in _placed(*order)], payload_hash(compared), F.when(passed, "T").otherwise("F"), _row_as_text(schema))
    rows = ticks.select(F.col(key).alias("_key"), line.alias("_line"))

    def changes(_key: tuple, parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        newest = max(max(part["_line"].tolist()) for part in parts)
        value = newest[HASH_FROM:HASH_TO]
        if newest[HASH_TO] == "T" and not (state.exists and state.get[0] == value):
            state.update((value,))
            yield pd.DataFrame({"_row": [newest[HASH_TO + 1:]]})
        if state.exists:
            _arm(state, ttl_seconds)

    timeout = GroupStateTimeout.NoTimeout if ttl_seconds is None else GroupStateTimeout.ProcessingTimeTimeout
    changed = rows.groupBy("_key").applyInPandasWithState(changes, "_row string", "hash string", "append", timeout)
    return _columns_from_text(changed, schema)
