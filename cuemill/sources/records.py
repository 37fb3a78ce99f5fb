"""Small text records: descriptions of media in XML, environment files, glossaries, manifests, folders of takes, which reader a file needs."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from cuemill.sources.subtitles import is_microdvd

#: Largest description that is read (fixed value).
NFO_BYTES = 2 * 1024 * 1024
NFO_FIELDS = StructType([StructField("media_type", StringType()), StructField("title", StringType()), StructField("media_year", IntegerType()), StructField("imdb_id", StringType()), StructField("tmdb_id", StringType()), StructField("tvdb_id", StringType())])
_ID = {"imdb_id": re.compile(r"tt\d{7,10}"), "tmdb_id": re.compile(r"\d{1,9}"), "tvdb_id": re.compile(r"\d{1,9}")}


def read_nfo(text: str | None) -> tuple:
    """media_type, title, media_year and ids of a description; nulls for one that is too large, declares entities or isn't XML."""
    none = (None,) * len(NFO_FIELDS)
    if not text or len(text.encode("utf-8", "replace")) > NFO_BYTES or re.search(r"<!\s*(?:doctype|entity)", text, re.I):
        return none
    try:
        root = ET.fromstring(text.strip())
    except ET.ParseError:
        return none
    kind = "tv" if root.tag.lower() in ("tvshow", "episodedetails") else "movie"
    one = lambda *names: next((v for n in names if (v := (root.findtext(n) or "").strip())), None)
    title = one("showtitle", "title") if kind == "tv" else one("title")
    year = re.search(r"(?:18|19|20)\d{2}", one("year", "premiered", "aired") or "")
    ids = {f"{(u.get('type') or '').lower()}_id": (u.text or "").strip() for u in root.iter("uniqueid")}
    for key in _ID:
        ids.setdefault(key, one(key, key.replace("_", "")) or "")
    return kind, title, int(year[0]) if year else None, *[ids[k] if form.fullmatch(ids[k]) else None for k, form in _ID.items()]


@F.pandas_udf(NFO_FIELDS)
def parse_nfo(texts: pd.Series) -> pd.DataFrame:
    frame = pd.DataFrame([read_nfo(t) for t in texts], columns=NFO_FIELDS.names)
    return frame.astype({"media_year": "Int64"})


def env_entries(files: DataFrame) -> DataFrame:
    """key, value of environment files (file, content): comments, lines without `=` and odd keys are passed over, quotes go, the first of a key in a file wins."""
    rows = files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).where(~F.ltrim("line").startswith("#") & F.col("line").contains("="))
    key, value = F.trim(F.substring_index("line", "=", 1)), F.trim(F.expr("substring(line, instr(line, '=') + 1)"))
    rows = rows.select("file", "pos", key.alias("key"), F.regexp_replace(value, r"^([\"'])(.*)\1$", "$2").alias("value")).where(F.col("key").rlike(r"^[A-Za-z_][A-Za-z0-9_]*$"))
    return rows.groupBy("file", "key").agg(F.min_by("value", "pos").alias("value"))


def glossary_entries(files: DataFrame) -> DataFrame:
    """term, pronunciation of lines `term = pronunciation` (file, content); both sides must hold something, the last of a term wins."""
    rows = files.select("file", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).where(F.col("line").contains("="))
    rows = rows.select("file", "pos", F.trim(F.substring_index("line", "=", 1)).alias("term"), F.trim(F.expr("substring(line, instr(line, '=') + 1)")).alias("said")).where("term <> '' and said <> ''")
    return rows.groupBy("file", "term").agg(F.max_by("said", "pos").alias("said"))


def read_manifest(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a worker's manifest (a JSON array or an object a line) of a known schema; rows that can't be read are left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").option("multiLine", True).json(path)


def takes(spark: SparkSession, path: str) -> DataFrame:
    """line_no, taken_at, path of folders `<line>/<time>/...` of takes, the newest of a line first by number; names that are no numbers are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    part = lambda i: F.regexp_extract("path", r"/(\d+)/(\d+)/[^/]+$", i)
    every = files.select(part(1).alias("line_no"), part(2).alias("taken_at"), "path").where("line_no <> ''")
    return every.select(F.col("line_no").cast("bigint"), F.col("taken_at").cast("bigint"), "path")


def reader_of(name: Column, content: Column) -> Column:
    """Which reader a subtitle file needs: `srt`, `microdvd` for a .sub that looks like it, else `convert`."""
    low = F.lower(name)
    return F.when(low.endswith(".srt"), "srt").when(low.endswith(".sub") & is_microdvd(content), "microdvd").otherwise("convert")


def probed_streams(probes: DataFrame) -> DataFrame:
    """file, index, kind, codec, language, title, channels, is_default of container descriptions (file, probe: JSON text); unreadable ones give no rows."""
    schema = "struct<streams: array<struct<index: int, codec_type: string, codec_name: string, channels: int, tags: map<string, string>, disposition: map<string, int>>>>"
    rows = probes.select("file", F.explode(F.from_json("probe", schema)["streams"]).alias("s"))
    language = F.lower(F.coalesce(F.col("s.tags")["language"], F.lit("und")))
    return rows.select("file", "s.index", F.col("s.codec_type").alias("kind"), F.col("s.codec_name").alias("codec"), language.alias("language"), F.col("s.tags")["title"].alias("title"), "s.channels", F.coalesce(F.col("s.disposition")["default"] == 1, F.lit(False)).alias("is_default"))


def with_sidecar(sources: DataFrame, sidecars: DataFrame, file: str = "file") -> DataFrame:
    """source, sidecar: a single source takes all sidecars; of several each takes those of its own stem, without regard to case."""
    stem = lambda c: F.lower(F.regexp_replace(c, r"\.[^.]*$", ""))
    one = sources.agg(F.count(F.lit(1)).alias("n"), F.min(file).alias("only")).where("n = 1")
    s, x = sources.select(F.col(file).alias("source"), stem(file).alias("stem")), sidecars.select(F.col(file).alias("sidecar"), stem(file).alias("stem"))
    alone = x.join(F.broadcast(one)).select(F.col("only").alias("source"), "sidecar")  # one row at most
    return s.join(x, "stem").select("source", "sidecar").unionByName(alone).distinct()


def replace_table(df: DataFrame, path: str) -> None:
    """Puts a table in the place of another: it is written beside it first and renamed when it is whole."""
    spark = df.sparkSession
    jvm = spark._jvm
    fresh, old = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + x) for x in (".tmp", ""))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(fresh.toString())
    fs.delete(old, True)
    fs.rename(fresh, old)
