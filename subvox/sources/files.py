"""Recordings kept as array files: listed, split and read by tasks.

Files are found with Spark's own ``binaryFile`` listing (no content is read), their small
headers are read by tasks, and each block of samples is one row of work that reads only
its own bytes. So one huge recording and many small ones are both spread over the cluster.
Paths must be reachable from all executors (a shared mount or an object store).
"""

from __future__ import annotations

import ast
import io
import re
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subvox.functions.fixed import TRIAL_SAMPLES, TRIAL_WORD_SAMPLES
from subvox.functions.text import first_word, slug
from subvox.operators.blocks import block_frames

EVENT_FIELDS = "session_id string, event_id bigint, start_sample bigint, end_sample bigint, label string, trial_id bigint, word_idx int"
PHONE_FIELDS = "session_id string, phone_idx bigint, start_sample bigint, end_sample bigint, phone string, word string"
BLOCK_FIELDS = "session_id string, block bigint, start_sample bigint, n_frames int, channels int, samples array<float>"


def _open(path: str):
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        local = "/" + path[5:].lstrip("/") if path.startswith("file:") else path
        return fs.LocalFileSystem().open_input_file(local)
    system, name = fs.FileSystem.from_uri(quote(path, safe=":/"))
    return system.open_input_file(unquote(name))


def npy_header(path: str) -> tuple[tuple[int, ...], np.dtype, bool, int]:
    """Shape, type, column-major flag and data offset of an array file."""
    with _open(path) as f:
        head = f.read(12)
        if head[:6] != b"\x93NUMPY":
            raise ValueError(f"{path} is not an array file")
        size, skip = (int.from_bytes(head[8:10], "little"), 10) if head[6] == 1 else (int.from_bytes(head[8:12], "little"), 12)
        f.seek(skip)
        facts = ast.literal_eval(f.read(size).decode("latin1"))
    return tuple(facts["shape"]), np.dtype(facts["descr"]), bool(facts["fortran_order"]), skip + size


def npy_rows(path: str, first: int, count: int) -> np.ndarray:
    """Rows ``first`` to ``first + count`` along the first axis; only their bytes are read."""
    shape, kind, by_column, offset = npy_header(path)
    if by_column:
        with _open(path) as f:
            return np.load(io.BytesIO(f.read()))[first : first + count]
    each = int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize
    count = max(0, min(count, shape[0] - first))
    with _open(path) as f:
        f.seek(offset + first * each)
        data = f.read(count * each)
    return np.frombuffer(data, dtype=kind).reshape(count, *shape[1:])


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``path, folder, name, bytes`` of the matching files below ``path``; contents are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select(
        "path", F.regexp_replace("path", "/[^/]*$", "").alias("folder"), F.regexp_extract("path", "([^/]*)$", 1).alias("name"),
        F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"),
    )


def _texts(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    files = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def _below(path: str, root: str):
    """``path`` relative to the folder that is read, so that equal names in two folders stay apart; whole if the root is a pattern."""
    plain = F.regexp_replace(path, "^[a-z0-9]+:/+", "/")
    base = re.sub("^[a-z0-9]+:/+", "/", root.rstrip("/")) + "/"
    return F.when(F.startswith(plain, F.lit(base)), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)


def _session_of(path: str, root: str):
    """Folder of a file below ``root``; the root's own name for files that lie in it directly."""
    folder = F.regexp_replace(_below(path, root), "/?[^/]*$", "")
    return F.when(folder == "", F.lit(root.rstrip("/").rsplit("/", 1)[-1])).otherwise(folder)


def read_sessions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Session folders below ``path`` as ``sessions``, ``signal_blocks`` and ``events``.

    A folder has ``signals.npy`` (time, channels), ``events.csv`` and ``meta.json`` or
    ``session.json``; its place below ``path`` is the session.
    """
    facts = "fs_hz double, channels int, user_id string, source string, preprocessing_mode string, split_mode string"
    meta = _texts(spark, path, "{meta,session}.json").select(_session_of("path", path).alias("session_id"), F.from_json("text", facts).alias("m"), "text")
    sessions = meta.groupBy("session_id").agg(
        F.max("m.fs_hz").alias("fs_hz"), F.max("m.channels").alias("channels"), F.max("m.user_id").alias("user_id"),
        F.max("m.source").alias("source"), F.max("m.preprocessing_mode").alias("mode"),
        F.coalesce(F.max("m.split_mode"), F.lit("")).alias("split_mode"), F.max("text").alias("meta"),
    )
    signals = list_files(spark, path, "signals.npy").select("path", _session_of("path", path).alias("session_id")).join(
        sessions.select("session_id", "fs_hz"), "session_id"
    )
    return sessions, read_arrays(signals), read_events(spark, path)


def read_arrays(files: DataFrame) -> DataFrame:
    """Block rows of array files listed as ``session_id, path, fs_hz``."""

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, p, fs in zip(pdf["session_id"], pdf["path"], pdf["fs_hz"]):
                shape, _, _, _ = npy_header(p)
                size = block_frames(fs)
                n = -(-shape[0] // size)
                yield pd.DataFrame({"session_id": s, "path": p, "size": size, "block": range(n)})

    work = files.select("session_id", "path", "fs_hz").repartition(F.col("path")).mapInPandas(
        plan, "session_id string, path string, size int, block bigint"
    )

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for s, p, size, b in zip(pdf["session_id"], pdf["path"], pdf["size"], pdf["block"]):
                x = npy_rows(p, int(b) * int(size), int(size)).astype(np.float32)
                x = x.reshape(len(x), -1)
                rows.append((s, b, int(b) * int(size), len(x), x.shape[1], x.ravel()))
            yield pd.DataFrame(rows, columns=["session_id", "block", "start_sample", "n_frames", "channels", "samples"])

    return work.repartition(F.col("path"), F.col("block")).mapInPandas(load, BLOCK_FIELDS)


def _span_tables(spark: SparkSession, path: str, name: str, needs: list[str], others: list[str], fields: str, number: str) -> DataFrame:
    """Tables of spans named ``name`` in the session folders below ``path``, their rows numbered; optional columns are null where absent."""
    types = dict(f.split(" ") for f in fields.split(", "))
    kinds = {c: "Int64" if types[c] != "string" else str if c in needs else "string" for c in (*needs, *others)}
    absent = {c: ["", "nan", "NaN", "NA", "None", "null"] if kind == "Int64" else [""] for c, kind in kinds.items()}  # "null" is a word like others

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, text in zip(pdf["session_id"], pdf["text"]):
                rows = pd.read_csv(io.StringIO(text), comment="#", keep_default_na=False, na_values=absent)
                missing = set(needs) - set(rows.columns)
                if missing:
                    raise ValueError(f"{name} of {s} lacks {sorted(missing)}")
                rows = rows.reindex(columns=[*needs, *others]).astype(kinds)
                yield rows.assign(**{"session_id": s, number: range(len(rows))})[list(types)]

    texts = _texts(spark, path, name).select(_session_of("path", path).alias("session_id"), "text")
    return texts.mapInPandas(parse, fields)


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """``events.csv`` of every session folder; optional columns are null where absent."""
    return _span_tables(spark, path, "events.csv", ["start_sample", "end_sample", "label"], ["trial_id", "word_idx"], EVENT_FIELDS, "event_id")


def read_phones(spark: SparkSession, path: str) -> DataFrame:
    """``phonemes.csv`` of the session folders that have one: the span of each phone and the word it is said in."""
    return _span_tables(spark, path, "phonemes.csv", ["start_sample", "end_sample", "phone"], ["word"], PHONE_FIELDS, "phone_idx")


def word_span(samples: int, word: Column, words: Column) -> tuple[Column, Column]:
    """First sample and end of word number ``word`` out of ``words``: the fixed cut for whole trials, else equal parts, the rest to the last."""
    fixed = (words == len(TRIAL_WORD_SAMPLES)) & F.lit(samples == TRIAL_SAMPLES)
    edges = F.array(*[F.lit(int(e)) for e in np.cumsum([0, *TRIAL_WORD_SAMPLES])])
    each = F.greatest(F.floor(F.lit(samples) / words), F.lit(1)).cast("long")
    equal_end = F.when(word + 1 == words, F.lit(samples)).otherwise((word + 1) * each)
    return F.when(fixed, F.get(edges, word)).otherwise(word * each), F.when(fixed, F.get(edges, word + 1)).otherwise(equal_end)


def read_trial_cube(spark: SparkSession, data: str, labels: str, *, words: int = 4, zscore: bool = True, fs_hz: float = 5000.0) -> tuple[DataFrame, DataFrame]:
    """A ``(trials, channels, time)`` array with a ``(trials, words)`` label array.

    Each trial is a session of its own (``session_id`` = trial number), read by one task
    row; words are spans of it, those under 16 frames are left out. Returns the blocks and
    the events.
    """
    shape = npy_header(data)[0]
    trials = spark.range(min(shape[0], npy_header(labels)[0][0])).withColumnRenamed("id", "trial_id")
    size = block_frames(fs_hz)

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for t in pdf["trial_id"]:
                x = npy_rows(data, int(t), 1)[0].astype(np.float32).T
                if zscore:
                    x = (x - x.mean(axis=0)) / (x.std(axis=0) + 1e-8)
                parts = [x[i : i + size] for i in range(0, len(x), size)]
                yield pd.DataFrame(
                    {
                        "session_id": str(t), "block": range(len(parts)), "start_sample": [i * size for i in range(len(parts))],
                        "n_frames": [len(p) for p in parts], "channels": x.shape[1], "samples": [p.astype(np.float32).ravel() for p in parts],
                    }
                )

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = [[str(w) for w in npy_rows(labels, int(t), 1)[0][:words]] for t in pdf["trial_id"]]
            yield pd.DataFrame({"trial_id": pdf["trial_id"], "labels": lists})

    said = trials.mapInPandas(spoken, "trial_id long, labels array<string>").select("trial_id", F.size("labels").alias("n"), F.posexplode("labels").alias("word", "label"))
    start, end = word_span(shape[2], F.col("word"), F.col("n"))
    said = said.withColumns({"session_id": F.col("trial_id").cast("string"), "start_sample": start, "end_sample": end, "event_id": F.col("word"), "word_idx": F.col("word")}).where("end_sample - start_sample >= 16")
    events = said.select(*[F.col(f.split(" ")[0]).cast(f.split(" ")[1]) for f in EVENT_FIELDS.split(", ")])
    events = events.withColumn("label", slug(F.col("label")))
    return trials.mapInPandas(load, BLOCK_FIELDS), events


def _whole_array(files: DataFrame, least: int, channels: int | None) -> DataFrame:
    """Adds ``n_frames, channels`` from the headers and drops arrays that are too short or misshapen."""

    def look(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            shapes = [npy_header(p)[0] for p in pdf["path"]]
            yield pdf.assign(n_frames=[s[0] for s in shapes], channels=[s[1] if len(s) == 2 else 0 for s in shapes])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema)
    out = files.mapInPandas(look, f"{fields}, n_frames bigint, channels int").where(F.col("n_frames") >= least)
    return out.where(F.col("channels") == channels) if channels else out.where("channels > 0")


def read_paired_recordings(
    spark: SparkSession, path: str, *, silent_only: bool = True, label_mode: str = "first_word", channels: int = 8, fs_hz: float = 1000.0
) -> tuple[DataFrame, DataFrame]:
    """``*_emg.npy`` with ``*_info.json``: one recording and one whole-recording event per pair.

    Pairs with a negative sentence index, no text, sound (if ``silent_only``), another
    channel count or under 32 frames are left out. Spans follow the samples exactly.
    """
    info = _texts(spark, path, "*_info.json").select(
        F.regexp_replace("path", "_info[.]json$", "").alias("stem"),
        F.from_json("text", "text string, sentence_index int, silent boolean").alias("i"),
    )
    files = list_files(spark, path, "*_emg.npy").select("path", F.regexp_replace("path", "_emg[.]npy$", "").alias("stem"))
    # The two readers may write the scheme of a path differently, so the plain path is the key.
    plain = F.regexp_replace("stem", "^[a-z0-9]+:/+", "/")
    pairs = files.withColumn("stem", plain).join(info.withColumn("stem", plain), "stem")
    text = F.trim("i.text")
    pairs = pairs.where((F.coalesce("i.sentence_index", F.lit(0)) >= 0) & (F.coalesce(text, F.lit("")) != ""))
    if silent_only:
        pairs = pairs.where(F.coalesce("i.silent", F.lit(True)))
    if label_mode not in ("sentence", "first_word"):
        raise ValueError(f"unknown label mode {label_mode}")
    label = slug(text if label_mode == "sentence" else first_word(text))
    named = pairs.select("path", _below("stem", path).alias("session_id"), label.alias("label"))
    kept = _whole_array(named, 32, channels)
    events = kept.select(
        "session_id", F.lit(0).cast("bigint").alias("event_id"), F.lit(0).cast("bigint").alias("start_sample"),
        F.col("n_frames").alias("end_sample"), "label", F.lit(None).cast("bigint").alias("trial_id"), F.lit(None).cast("int").alias("word_idx"),
    )
    return read_arrays(kept.withColumn("fs_hz", F.lit(float(fs_hz)))), events


def read_segment_set(spark: SparkSession, path: str, *, fs_hz: float = 5000.0) -> tuple[DataFrame, DataFrame]:
    """One array file per trial; the slug of its name is the label; under 16 frames left out."""
    files = list_files(spark, path, "*.npy")
    stem = F.regexp_replace("name", "[.]npy$", "")
    kept = _whole_array(files.select("path", F.regexp_replace(_below("path", path), "[.]npy$", "").alias("session_id"), slug(stem).alias("label")), 16, None)
    events = kept.select(
        "session_id", F.lit(0).cast("bigint").alias("event_id"), F.lit(0).cast("bigint").alias("start_sample"),
        F.col("n_frames").alias("end_sample"), "label", F.lit(None).cast("bigint").alias("trial_id"), F.lit(None).cast("int").alias("word_idx"),
    )
    return read_arrays(kept.withColumn("fs_hz", F.lit(float(fs_hz)))), events


def write_tables(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Parquet partitioned by session; a hot session is spread over files by block."""
    spread = df.repartition(F.col("session_id"), F.col("block")) if "block" in df.columns else df
    spread.write.mode(mode).partitionBy("session_id").parquet(path)

