"""Raw device packets: decoding, live reading and message rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subvox.functions.arrays import microvolts_per_count
from subvox.functions.fixed import PACKET_HEADER_BYTES, PACKET_MAGIC, PACKET_VERSION

DECODED = (
    "device_id string, arrival_no bigint, channels int, n_frames int, flags int, seq bigint, sample_index bigint, samples array<float>, reject string"
)

HEADER = np.dtype(
    [("magic", "<u2"), ("version", "u1"), ("channels", "u1"), ("n_frames", "<u2"), ("flags", "<u2"), ("seq", "<u4"), ("sample_index", "<u8")]
)
#: Bytes of packets unfolded at once, about.
BYTES_AT_ONCE = 1 << 20


def decode_packets(packets: DataFrame, *, bits: int = 16, vref: float = 2.4, gain: float = 24.0, raw_channels: int | None = None) -> DataFrame:
    """``device_id, arrival_no, payload`` to samples in microvolts; bad packets keep a ``reject`` reason.

    The header is little endian: magic, version, channels, frames, flags, sequence, sample
    index. With ``raw_channels`` payloads have no header and hold interleaved 16-bit counts.
    Works on batch and streaming frames alike.
    """
    scale = microvolts_per_count(bits, vref, gain)

    def decode(payloads: pa.Array) -> list[pa.Array]:
        data = payloads.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        bounds = np.frombuffer(payloads.buffers()[1], np.int32)[payloads.offset : payloads.offset + len(payloads) + 1].astype(np.int64)
        start, size = bounds[:-1], np.diff(bounds)
        reject, head = np.full(len(size), None, object), 0 if raw_channels else PACKET_HEADER_BYTES
        if raw_channels:
            odd = size % (2 * raw_channels) != 0
            reject[odd] = [f"{n} bytes do not hold whole frames" for n in size[odd]]
            names = {"channels": np.full(len(size), raw_channels), "n_frames": size // (2 * raw_channels), "flags": np.zeros(len(size), int)}
        else:
            short = size < PACKET_HEADER_BYTES
            reject[short] = "payload too short"
            heads = np.zeros((len(size), PACKET_HEADER_BYTES), np.uint8)
            heads[~short] = data[start[~short, None] + np.arange(PACKET_HEADER_BYTES)]
            names = heads.view(HEADER)[:, 0]
            due = head + names["n_frames"].astype(np.int64) * names["channels"] * 2
            version = names["version"]
            for broken, reason in (
                (names["magic"] != int.from_bytes(PACKET_MAGIC, "little"), lambda i: "bad magic"),
                (version != PACKET_VERSION, lambda i: f"unsupported version {version[i]}"),
                (names["n_frames"] == 0, lambda i: "no frames"),
                (size != due, lambda i: f"length mismatch: {size[i]} bytes, expected {due[i]}"),
            ):
                at = np.flatnonzero(broken & (reject == None))  # noqa: E711
                reject[at] = [reason(i) for i in at]
        bad = reject != None  # noqa: E711
        counts = np.where(bad, 0, (size - head) // 2)
        ends = np.cumsum([0, *counts], dtype=np.int64)
        at = np.repeat(start + head - 2 * ends[:-1], counts) + 2 * np.arange(ends[-1])  # first byte of each sample
        wide = (data[at] | data[at + 1].astype(np.uint16) << 8).astype(np.uint16).view(np.int16)
        offsets = pa.array(ends, pa.int32(), mask=np.append(bad, False))
        samples = pa.ListArray.from_arrays(offsets, pa.array(wide.astype(np.float32) * np.float32(scale)))
        of = lambda name, kind: pa.array(np.where(bad, 0, names[name]), mask=bad).cast(kind)
        numbers = [of("channels", pa.int32()), of("n_frames", pa.int32()), of("flags", pa.int32())]
        numbers += [pa.nulls(len(size), pa.int64())] * 2 if raw_channels else [of("seq", pa.int64()), of("sample_index", pa.int64())]
        return [*numbers, samples, pa.array(reject, pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["device_id", "arrival_no", "channels", "n_frames", "flags", "seq", "sample_index", "samples", "reject"]
        for batch in batches:
            step = max(1, BYTES_AT_ONCE * len(batch) // max(1, batch.nbytes))
            for first in range(0, len(batch), step):
                part = batch.slice(first, step)
                if part["payload"].null_count:
                    raise ValueError("a payload is null")
                yield pa.RecordBatch.from_arrays([part["device_id"], part["arrival_no"], *decode(part["payload"].cast(pa.binary()))], names)

    return packets.select(F.col("device_id").cast("string").alias("device_id"), F.col("arrival_no").cast("long").alias("arrival_no"), "payload").mapInArrow(run, DECODED)


def read_packet_stream(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """Packet rows that appear as parquet files; ``device_id, arrival_no, arrived_at, payload``."""
    return (
        spark.readStream.schema("device_id string, arrival_no bigint, arrived_at timestamp, payload binary")
        .option("maxFilesPerTrigger", max_files)
        .parquet(path)
    )


def read_packet_topic(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from a Kafka topic (key = device, offset = arrival); needs the Kafka connector jar."""
    rows = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return rows.select(
        F.col("key").cast("string").alias("device_id"), F.col("offset").alias("arrival_no"), F.col("timestamp").alias("arrived_at"),
        F.col("value").alias("payload"),
    )


def token_messages(tokens: DataFrame, kind: str = "token", source: str = "unknown") -> DataFrame:
    """One JSON row per token, transcript or status; rows with a confidence outside [0, 1] are left out.

    Columns present are used: ``token`` or ``text``, ``confidence``, ``t``, ``seq``, ``status``, ``meta``.
    """
    named = [F.lit(kind).alias("type")]
    named += [F.col(c) for c in ("token", "text", "status", "confidence", "t", "seq", "alternatives", "utterance_id", "meta") if c in tokens.columns]
    named.append(F.lit(source).alias("source"))
    ok = tokens.where("confidence BETWEEN 0 AND 1") if "confidence" in tokens.columns else tokens
    key = [c for c in ("session_id",) if c in tokens.columns]
    return ok.select(*key, F.to_json(F.struct(*named)).alias("value"))
