"""Order-dependent groupings whose rule looks at the running group, folded over each bounded group in its order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def gap_duration_groups(rows: list[tuple[int, int, bool]], gap: int, longest: int, sentence: int) -> list[int]:
    """Group number of (start, end, ends_sentence) rows in order.

    A new group begins behind a pause over gap, where the running group is over longest, and behind a sentence end
    once the group is over sentence long.
    """
    out: list[int] = []
    number, begun, last = 0, 0, None
    for start, end, stop in rows:
        if last is None or start - last[1] > gap or last[1] - begun > longest or (last[2] and last[1] - begun > sentence):
            number += 1
            begun = start
        out.append(number)
        last = (start, end, stop)
    return out


def merge_padded(rows: list[tuple[int, int]], pad: int, gap: int, longest: int) -> list[tuple[int, int]]:
    """Hints widened by pad and merged while less than gap apart and no longer than longest together."""
    out: list[list[int]] = []
    for start, end in rows:
        a, b = max(0, start - pad), end + pad
        if out and a - out[-1][1] < gap and max(b, out[-1][1]) - out[-1][0] <= longest:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def parts(df: DataFrame, keys: list[str], start: str, end: str, pause: int) -> DataFrame:
    """df with part: the number of pauses over `pause` before a row, after the latest end so far. A fold that begins anew there may be run by part."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    latest = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    cut = df.withColumn("part", F.coalesce(F.col(start) - latest > pause, F.lit(False)).cast("bigint"))
    return cut.withColumn("part", F.sum("part").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))


def group_by_gap_and_duration(df: DataFrame, keys: list[str], start: str, end: str, stop: str, gap: int = 620, longest: int = 10_000, sentence: int = 700) -> DataFrame:
    """keys, group_no, start_ms, end_ms, rows, by the rule of gap_duration_groups. keys must bound a group: here a job, a speaker and a part of parts(). Folded over the rows as they come in order, so tiny parts cost no call each and long ones no memory."""
    placed = df.select(*keys, start, end, stop).repartition(*keys).sortWithinPartitions(*keys, start, end, stop)
    schema = StructType([*placed.schema.fields[: len(keys)], *[StructField(n, LongType()) for n in ("group_no", "start_ms", "end_ms", "rows")]])

    def fold(batches):
        import pyarrow as pa

        types, done = None, []
        key, number, begun, latest, last, stopped, rows = None, 0, 0, 0, 0, False, 0

        def told() -> pa.RecordBatch:
            columns = [list(x) for x in zip(*done)]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.fieldNames())

        for b in batches:
            types = types or [*b.schema.types[: len(keys)], *[pa.int64()] * 4]
            *ks, starts, ends, stops = (c.to_pylist() for c in b.columns)
            for k, s, e, stop_ in zip(zip(*ks), starts, ends, stops):
                if not rows or k != key or s - last > gap or last - begun > longest or (stopped and last - begun > sentence):
                    if rows:
                        done.append((*key, number, begun, latest, rows))
                    number = number + 1 if rows and k == key else 1
                    key, begun, latest, rows = k, s, e, 0
                latest, last, stopped, rows = max(latest, e), e, stop_, rows + 1
            if done:
                yield told()
        if rows:
            done.append((*key, number, begun, latest, rows))
            yield told()

    return placed.mapInArrow(fold, schema)


def merge_windows(df: DataFrame, keys: list[str], start: str, end: str, pad: int = 650, gap: int = 3_000, longest: int = 180_000) -> DataFrame:
    """keys, start_ms, end_ms: windows to listen to, from hints."""
    types = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        merged = merge_padded(sorted(zip(pdf[start], pdf[end])), pad, gap, longest)
        return pd.DataFrame([(*key, a, b) for a, b in merged], columns=[*keys, "start_ms", "end_ms"])

    return df.select(*keys, start, end).groupBy(*keys).applyInPandas(one, ", ".join(f"{k} {types[k]}" for k in keys) + ", start_ms long, end_ms long")
