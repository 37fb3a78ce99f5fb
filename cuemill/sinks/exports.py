"""Cues as subtitle text, cue sheets and edit lists; each is a table of lines, written with the ordinary writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import clock

FPS = 24


def srt_blocks(cues: DataFrame, group: str, start: str, end: str, text: str) -> DataFrame:
    """group, no (from 1), block: SubRip blocks of each group in the order of time."""
    w = Window.partitionBy(group).orderBy(start, end, text)
    no = F.row_number().over(w)
    return cues.withColumn("no", no).select(group, F.col("no").cast("bigint").alias("no"), F.concat(F.col("no").cast("string"), F.lit("\n"), clock(F.col(start)), F.lit(" --> "), clock(F.col(end)), F.lit("\n"), F.coalesce(F.col(text), F.lit("")), F.lit("\n")).alias("block"))


def timecode(ms: F.Column, fps: int = FPS) -> F.Column:
    """Non-drop time code HH:MM:SS:FF."""
    frames = F.floor(ms * fps / 1000)
    part = lambda x: F.lpad(F.floor(x).cast("string"), 2, "0")
    return F.concat_ws(":", part(frames / (3600 * fps)), part(F.pmod(F.floor(frames / (60 * fps)), F.lit(60))), part(F.pmod(F.floor(frames / fps), F.lit(60))), part(F.pmod(frames, F.lit(fps))))


def edit_list(cues: DataFrame, group: str, start: str, end: str) -> DataFrame:
    """group, no, event: lines of an edit decision list, source and record times alike."""
    w = Window.partitionBy(group).orderBy(start, end)
    times = F.concat_ws(" ", timecode(F.col(start)), timecode(F.col(end)))
    return cues.withColumn("no", F.row_number().over(w)).select(group, F.col("no").cast("bigint").alias("no"), F.concat_ws("  ", F.lpad(F.col("no").cast("string"), 3, "0"), F.lit("AX       AA    C       ") , times, times).alias("event"))


def write_srt(cues: DataFrame, path: str, group: str, start: str, end: str, text: str) -> None:
    """One folder of text for each group, its blocks in order."""
    blocks = srt_blocks(cues, group, start, end, text)
    blocks.repartition(group).sortWithinPartitions(group, "no").select(group, "block").write.partitionBy(group).mode("overwrite").text(path)


def write_cue_sheet(sheet: DataFrame, path: str) -> None:
    sheet.write.mode("overwrite").option("header", True).csv(path)


def write_by_speaker(cues: DataFrame, path: str) -> None:
    cues.write.partitionBy("speaker_id").mode("overwrite").parquet(path)
