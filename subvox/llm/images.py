"""Copies of images by local descriptors.

Corners are found on several scales; each gets the direction of its patch's brightness centroid, and a descriptor of
binary tests between points of the patch turned to that direction. Descriptors are cut into pieces, one Hamming table per
piece: two descriptors meet if a piece is equal. The tables of a block of searched images are joined with all images. Matches of two images vote for the turn, scale and shift
that carries one onto the other; images with enough corners behind one movement are copies, also if one is
cropped, brightened or noisy.

Images with equal pixels are one class, and only its smallest id is indexed and searched.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subvox.llm.common import partitions, saved
from subvox.session import checkpoint_dir

#: Scales of the pyramid, as steps between sampled pixels.
SCALES = (0.7, 1.0, 1.4)
RADIUS = 11
TESTS = 120
TABLES = 5
#: Corner response, as a part of the image's largest one.
RESPONSE = 0.02
#: Corners that must agree on one movement, and the bits in which two descriptors may differ.
INLIERS, BITS = 4, 30
#: Widths of the voting bins: degrees of turn, and pixels of shift.
TURN, SHIFT = 30, 12
#: Corners of a block of searched images, and blocks sent at once.
BLOCK_CORNERS, BLOCKS = 32_768, 4
#: In a task: images that vote together, pairs compared and movements counted at once, and pixels described at once.
IMAGES, CANDIDATES, COUNTERS, PIXELS = 64, 1 << 20, 1 << 17, 1 << 14


@functools.cache
def _tests() -> np.ndarray:
    """Pairs of points of the patch, from a seeded rule: normal around the centre, cut at the radius."""
    rng = np.random.default_rng(20)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (4 * TESTS, 2, 2)), -RADIUS + 2, RADIUS - 2)
    far = np.abs(points[:, 0] - points[:, 1]).sum(1) > 4
    return points[far][:TESTS]


def _blur(x: np.ndarray, y: np.ndarray, times: int = 1) -> np.ndarray:
    """Weights 1, 2, 1 down and across each image of a stack, with repeated borders. In place; ``y`` is room of the same size."""
    flat, room = x.reshape(-1), y.reshape(-1)
    for _ in range(times):
        np.multiply(flat, 2, out=room)
        y[:, 1:] += x[:, :-1]
        y[:, 0] += x[:, 0]
        y[:, :-1] += x[:, 1:]
        y[:, -1] += x[:, -1]
        # Across in one piece, as rows are short; then the columns at the border, which met those of the next row.
        np.multiply(room, 2, out=flat)
        flat[1:] += room[:-1]
        flat[:-1] += room[1:]
        x[:, :, 0] = 2 * y[:, :, 0] + y[:, :, 0] + y[:, :, 1]
        x[:, :, -1] = 2 * y[:, :, -1] + y[:, :, -2] + y[:, :, -1]
    x *= 1 / 16**times
    return x


def _between(size: int, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pixels before the places ``steps`` on an axis of ``size`` pixels, and how far behind them the places are."""
    at = np.clip(steps, 0, size - 1.001)
    return (i := at.astype(int)), at - i


def _sample(x: np.ndarray, of: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Bilinear values of the images number ``of`` of the stack ``x``."""
    h, w = x.shape[1:]
    (i, a), (j, b) = _between(h, row), _between(w, col)
    flat, at = x.reshape(-1), (of * h + i) * w + j
    value = lambda k: flat.take(at + k)
    return (1 - a) * ((1 - b) * value(0) + b * value(1)) + a * ((1 - b) * value(w) + b * value(w + 1))


def resize(x: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear resampling of the last two axes."""
    (i, a), (j, b) = (_between(x.shape[k], np.linspace(0, x.shape[k] - 1, n)) for k, n in ((-2, height), (-1, width)))
    x = (1 - b) * x.take(j, -1) + b * x.take(j + 1, -1)
    return (1 - a)[:, None] * x.take(i, -2) + a[:, None] * x.take(i + 1, -2)


def _slopes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients down and across, one-sided at the borders."""
    down, across = np.empty_like(x), np.empty_like(x)
    np.subtract(x[:, 2:], x[:, :-2], out=down[:, 1:-1])
    np.subtract(x.reshape(-1)[2:], x.reshape(-1)[:-2], out=across.reshape(-1)[1:-1])
    down *= 0.5
    across *= 0.5
    down[:, 0], down[:, -1] = x[:, 1] - x[:, 0], x[:, -1] - x[:, -2]
    across[:, :, 0], across[:, :, -1] = x[:, :, 1] - x[:, :, 0], x[:, :, -1] - x[:, :, -2]
    return down, across


def _peaks(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Image, row and column of each corner of a stack: above all 24 pixels around it and ``RESPONSE`` of its image's largest one."""
    yy, xx = _slopes(x)
    xy, room = xx * yy, np.empty_like(x)
    xx *= xx
    yy *= yy
    for p in (xx, yy, xy):
        _blur(p, room, 2)
    # xx * yy - xy ** 2 - 0.05 * (xx + yy) ** 2
    np.add(xx, yy, out=room)
    room *= room
    room *= 0.05
    response = np.multiply(xx, yy, out=xx)
    response -= np.square(xy, out=xy)
    response -= room
    most = response.max((1, 2))
    h = x.shape[1]
    # Corners keep off the border by more than two pixels, so each has all its neighbours, and rows may run into each other.
    row = lambda k: response[:, RADIUS + k : h - RADIUS + k]
    around = np.maximum(row(-2), row(-1))
    for k in (1, 2):
        np.maximum(around, row(k), out=around)
    with_centre = np.maximum(around, row(0)).reshape(-1)
    inner = around.reshape(-1)[2:-2]
    for k in (0, 1, 3, 4):
        np.maximum(inner, with_centre[k : len(inner) + k], out=inner)
    peak = (row(0) > around) & (row(0) > (RESPONSE * most)[:, None, None])
    peak[most <= 1e-6], peak[:, :, :RADIUS], peak[:, :, -RADIUS:] = False, False, False
    of, rows, cols = np.nonzero(peak)
    return of, rows + RADIUS, cols


@functools.cache
def _patch() -> tuple[np.ndarray, np.ndarray]:
    step = np.arange(-RADIUS, RADIUS + 1)
    return step, ((step[:, None] ** 2 + step[None] ** 2) <= RADIUS**2).astype(float)


def describe_all(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """``image, row, column, degrees, scale, bits`` of the corners of a stack of images of one size, as arrays by image and scale."""
    out = []
    step, disc = _patch()
    tests = _tests()
    for scale in SCALES:
        h, w = int(images.shape[1] / scale), int(images.shape[2] / scale)
        if min(h, w) < 2 * RADIUS + 3:
            continue
        x = resize(images, h, w) if scale != 1 else images.copy()
        _blur(x, np.empty_like(x))
        of, rows, cols = _peaks(x)
        if not len(rows):
            continue
        patch = x.reshape(-1).take(((of * h + rows) * w + cols)[:, None, None] + (step[:, None] * w + step)) * disc
        patch = patch - (patch.sum((1, 2)) / disc.sum())[:, None, None] * disc
        turn = np.arctan2((patch * step[:, None]).sum((1, 2)), (patch * step[None]).sum((1, 2)))
        cos, sin = np.cos(turn)[:, None, None], np.sin(turn)[:, None, None]
        r = rows[:, None, None] + tests[None, ..., 0] * cos + tests[None, ..., 1] * sin
        c = cols[:, None, None] - tests[None, ..., 0] * sin + tests[None, ..., 1] * cos
        values = _sample(x, of[:, None, None], r, c)
        zoom = (images.shape[1] - 1) / max(h - 1, 1)
        out.append((of, rows * zoom, cols * zoom, np.degrees(turn), np.full(len(of), scale), values[..., 0] < values[..., 1]))
    if not out:
        return (np.zeros(0, int), *(np.zeros(0) for _ in range(4)), np.zeros((0, TESTS), bool))
    out = [np.concatenate(part) for part in zip(*out)]
    order = np.argsort(out[0], kind="stable")
    return tuple(part[order] for part in out)


def describe(image: np.ndarray) -> list[tuple[float, float, float, float, np.ndarray]]:
    """``row, column, degrees, scale, bits`` of each corner, in pixels of the full image. Flat and tiny images have none."""
    _, *values, bits = describe_all(np.asarray(image, float)[None])
    return [(*map(float, v), d) for *v, d in zip(*values, bits)]


def pieces(bits: np.ndarray) -> np.ndarray:
    """One number per Hamming table of a descriptor, or of each of several."""
    parts = bits.reshape(*bits.shape[:-1], TABLES, TESTS // TABLES).astype(np.int64)
    return parts @ (1 << np.arange(parts.shape[-1], dtype=np.int64))


IMAGE_FIELDS = "_id long, _n int, _row array<double>, _col array<double>, _turn array<double>, _scale array<double>, _keys array<long>"


def described(images: DataFrame, decode) -> DataFrame:
    """One row per image of ``_id, _data`` that has corners: their number and values; ``decode`` makes a gray array of the data.

    ``_keys`` holds the pieces of all corners, ``TABLES`` for each. Images of one size are described in stacks of about
    ``PIXELS`` pixels.
    """

    def rows(ids: list[int], stack: list[np.ndarray]) -> Iterator[tuple]:
        of, *values, bits = describe_all(np.stack(stack))
        ends = np.searchsorted(of, np.arange(1, len(ids)))
        columns = [np.split(v, ends) for v in (*values, pieces(bits))]
        yield from ((i, len(v[0]), *v[:-1], v[-1].ravel()) for i, *v in zip(ids, *columns) if len(v[0]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out, waiting = [], {}
            for i, d in zip(batch["_id"], batch["_data"]):
                if (x := decode(d)) is None:
                    continue
                ids, stack = waiting.setdefault(x.shape, ([], []))
                ids.append(i)
                stack.append(np.asarray(x, float))
                if len(stack) * x.size >= PIXELS:
                    out += rows(*waiting.pop(x.shape))
            for ids, stack in waiting.values():
                out += rows(ids, stack)
            yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in IMAGE_FIELDS.split(", ")])

    return images.mapInPandas(run, IMAGE_FIELDS)


class Corners:
    """Corners of several images as flat arrays; ``of`` is the number of the image in ``ids``."""

    def __init__(self, table: pa.RecordBatch | pa.Table):
        flat = lambda c: pc.list_flatten(table.column(c)).to_numpy()
        self.ids, n = table.column("_id").to_numpy(), table.column("_n").to_numpy().astype(np.int64)
        self.of, self.ends = np.repeat(np.arange(len(n)), n), np.cumsum(n)
        self.begins = self.ends - n
        self.row, self.col, self.turn, self.scale = (flat(c) for c in ("_row", "_col", "_turn", "_scale"))
        self.keys = flat("_keys").reshape(-1, TABLES)
        # The same bits, two pieces a word.
        self.words = [_joined(self.keys[:, t : t + 2]) for t in range(0, TABLES, 2)]
        self.step = np.round(np.log2(self.scale) * 2).astype(np.int64)


#: Steps of zoom of the scales: two corners differ by the bin of the zoom between them.
STEPS = np.round(np.log2(SCALES) * 2).astype(np.int64)
ZOOMS, TURNS = 2 * int(np.ptp(STEPS)) + 1, 360 // TURN
#: Bins of turns: of 0 to 360 degrees, then of -360 to 0, which negative places of the array mean.
_WRAPPED = np.concatenate([np.arange(TURNS + 1), np.arange(-TURNS, 0)]) % TURNS


def _turned(degrees: np.ndarray) -> np.ndarray:
    """Number of the bin of a difference of two directions; the array is used up."""
    degrees /= TURN
    return _WRAPPED[np.rint(degrees, out=degrees).astype(np.int64)]


def _numbered(keys: np.ndarray) -> np.ndarray:
    """Pieces with the number of their table before them."""
    return keys + (np.arange(TABLES, dtype=np.int64) << TESTS // TABLES)


#: Masks of the pieces of a word.
_PIECES = [((1 << TESTS // TABLES) - 1) << k * (TESTS // TABLES) for k in (0, 1)]


def _joined(keys: np.ndarray) -> np.ndarray:
    return keys @ (1 << np.arange(keys.shape[1], dtype=np.int64) * (TESTS // TABLES))


class HammingTables:
    """Sorted Hamming tables over the corners of a block of searched images.

    The tables lie one after another: ``corner`` has the corners in the order of their pieces, ``keys`` the distinct
    pieces, ``start`` where each begins.
    """

    def __init__(self, corners: Corners):
        self.corners = c = corners
        # Corners at one place, found on several scales, are one voter.
        self.voter = pd.DataFrame({"of": c.of, "row": c.row, "col": c.col}).groupby(["of", "row", "col"]).ngroup().to_numpy()
        keys = _numbered(c.keys).T.ravel()
        order = np.argsort(keys, kind="stable")
        self.keys, start = np.unique(keys[order], return_index=True)
        self.start, self.corner = np.append(start, len(keys)), order % max(1, len(c.of))
        self.turn = c.turn[self.corner]
        self.cell = ((c.of * ZOOMS + c.step - STEPS.min()) * TURNS)[self.corner]

    def candidates(self, images: Corners, first: int, last: int) -> Iterator[tuple[np.ndarray, ...]]:
        """Pairs of corners that share a piece: searched corner, corner of the images ``first`` to ``last - 1``, table, and
        one number for the two images and the bins of turn and zoom.

        Left out are pairs whose images have fewer than ``INLIERS`` of them in these bins: a movement has no more voters
        than matches of its turn and zoom.
        """
        span = slice(int(images.begins[first]), int(images.ends[last - 1]))
        key = _numbered(images.keys[span]).ravel()
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        size = np.where(self.keys[at] == key, self.start[at + 1] - self.start[at], 0)
        ends = np.append(0, np.cumsum(size))  # of the pairs of each row of ``key``
        shift = self.start[at] - ends[:-1]
        mine, table = np.repeat(np.arange(span.start, span.stop), TABLES), np.tile(np.arange(TABLES), span.stop - span.start)
        turn = images.turn[mine]
        cells = len(self.corners.ids) * ZOOMS * TURNS
        together = max(1, COUNTERS // cells)
        cell = ((images.of[mine] - first) % together * len(self.corners.ids) * ZOOMS + STEPS.max() - images.step[mine]) * TURNS
        bounds = TABLES * (np.append(images.begins[first:last:together], span.stop) - span.start)

        def pairs(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
            there = np.arange(ends[a], ends[b])
            there += np.repeat(shift[a:b], size[a:b])
            angle = self.turn[there]
            angle -= np.repeat(turn[a:b], size[a:b])
            code = _turned(angle)
            code += self.cell[there]
            code += np.repeat(cell[a:b], size[a:b])
            return there, code

        for group, (low, high) in enumerate(zip(bounds, bounds[1:])):
            # Slices of about CANDIDATES pairs; more than one are made anew after counting.
            cuts = [low]
            while cuts[-1] < high:
                cuts.append(min(high, max(cuts[-1] + 1, int(np.searchsorted(ends, ends[cuts[-1]] + CANDIDATES, "right")) - 1)))
            slices, counts, made = list(zip(cuts, cuts[1:])), None, None
            for a, b in slices:
                made = pairs(a, b)
                n = np.bincount(made[1], minlength=cells * together)
                counts = n if counts is None else counts + n
            for a, b in slices:
                there, code = made if len(slices) == 1 else pairs(a, b)
                busy = np.flatnonzero(counts[code] >= INLIERS)
                row = np.repeat(np.arange(a, b), size[a:b])[busy]
                yield self.corner[there[busy]], mine[row], table[row], code[busy] + group * together * cells

    def near(self, images: Corners, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the candidates, the pairs that differ in at most ``BITS`` bits, each once, and their numbers."""
        found = [(np.zeros(0, np.int64),) * 3]
        for other, mine, table, cell in self.candidates(images, first, last):
            differ, fresh = np.zeros(len(mine), np.uint8), np.ones(len(mine), bool)
            for w, (asked, word) in enumerate(zip(self.corners.words, images.words)):
                x = asked[other] ^ word[mine]
                differ += np.bitwise_count(x)
                # An earlier table has met the pair already if its piece is equal too.
                for u in range(2 * w, min(2 * w + 2, TABLES - 1)):
                    fresh &= (x & _PIECES[u - 2 * w] != 0) | (table <= u)
            keep = np.flatnonzero(fresh & (differ <= BITS))
            found.append((other[keep], mine[keep], cell[keep]))
        return tuple(np.concatenate(part) for part in zip(*found))

    def votes(self, images: Corners, first: int, last: int) -> pd.DataFrame:
        """``query, image, inliers`` of the images number ``first`` to ``last - 1``."""
        ask = self.corners
        q, i, cell = self.near(images, first, last)
        busy = _often(cell)
        q, i, cell = q[busy], i[busy], cell[busy]
        turn, zoom = np.radians(np.mod(ask.turn[q] - images.turn[i], 360.0)), ask.scale[q] / images.scale[i]
        cos, sin = np.cos(turn), np.sin(turn)
        row, col = images.row[i] * zoom, images.col[i] * zoom
        half = [np.floor(2 * x / SHIFT).astype(np.int64) for x in (ask.row[q] - (cos * row + sin * col), ask.col[q] - (cos * col - sin * row))]
        best = np.zeros(len(ask.ids) * (last - first), np.int64)  # by image, then query
        # Shifts are read off two grids, half a bin apart, so that a movement near a border is not split.
        for down in (0, 1):
            line = _code([cell, (half[0] + down) // 2])
            rows = _often(line)
            for right in (0, 1):
                bins = _code([line[rows], (half[1][rows] + right) // 2])
                often = _often(bins)
                movement, at = np.unique(bins[often], return_inverse=True)
                often = rows[often]
                voters = np.unique(at * len(self.voter) + self.voter[q[often]]) // len(self.voter)
                pair = np.zeros(len(movement), np.int64)
                pair[at] = cell[often] // (ZOOMS * TURNS)
                np.maximum.at(best, pair, np.bincount(voters, minlength=len(movement)))
        at = np.flatnonzero(best >= INLIERS)
        return pd.DataFrame({"query": ask.ids[at % len(ask.ids)], "image": images.ids[first + at // len(ask.ids)], "inliers": best[at]})


def _code(parts: list[np.ndarray]) -> np.ndarray:
    """One number for all parts."""
    code = np.zeros(len(parts[0]), np.int64)
    for p in parts:
        if len(p):
            low, wide = int(p.min()), int(p.max() - p.min()) + 1
            if int(code.max()) * wide > 1 << 62:
                code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            code = code * wide + (p - low)
    return code


def _often(code: np.ndarray) -> np.ndarray:
    """Places of all numbers that come ``INLIERS`` times or more, and of a few others: those whose hash bucket is so full."""
    bits = max(10, int(4 * len(code)).bit_length())
    hashed = ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).view(np.int64)
    return np.flatnonzero(np.bincount(hashed)[hashed] >= INLIERS) if len(code) else np.zeros(0, np.int64)


def matched_images(queries: DataFrame, images: DataFrame) -> DataFrame:
    """``query, image, inliers`` of two tables of described images: pairs whose corners agree on one movement.

    The searched images go in blocks of about ``BLOCK_CORNERS`` corners, ``BLOCKS`` at once sent to all tasks as Hamming tables.
    An image has all its corners in one row, so its matches vote where they are found: nothing is shuffled, and a match is never
    written. Only the pairs found are, round after round, to the shared folder.
    """
    spark = queries.sparkSession
    total = queries.agg(F.sum("_n")).first()[0] or 0
    blocks = -(-total // BLOCK_CORNERS)
    path = f"{checkpoint_dir(spark)}/matches-{uuid.uuid4().hex}"
    fields = "query long, image long, inliers long"
    spark.createDataFrame([], fields).write.parquet(path)
    numbered = queries.withColumn("_block", F.pmod(F.xxhash64("_id"), F.lit(max(1, blocks))))
    for block in range(0, blocks, BLOCKS):
        asked = numbered.where(F.col("_block").between(block, min(block + BLOCKS, blocks) - 1)).toArrow()
        parts = (Corners(asked.filter(pc.field("_block") == k)) for k in range(block, min(block + BLOCKS, blocks)))
        shared = spark.sparkContext.broadcast([HammingTables(c) for c in parts if len(c.ids)])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                images = Corners(batch)
                for tables in shared.value:
                    for first in range(0, len(images.ids), IMAGES):
                        yield pa.RecordBatch.from_pandas(tables.votes(images, first, min(first + IMAGES, len(images.ids))), preserve_index=False)

        images.mapInArrow(run, fields).write.mode("append").parquet(path)
        shared.destroy()
    return spark.read.schema(fields).parquet(path)


def find_copies(images: DataFrame, decode, alter, *, key: str, data: str, every: int = 50) -> DataFrame:
    """One row per image: ``key, class_id, n_corners, is_query, n_links, own_found, best_match, best_inliers``.

    ``class_id``: the smallest id with the same pixels. Each row whose id is divisible by ``every`` is searched, in the form
    that ``alter`` gives it, among all images: ``n_links`` counts the classes found, ``best_match`` is the best one of another
    class. Null keys and images: no class, no corners, no search. Repeated rows have one class. Empty table: no rows.
    """

    def digest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if (x := decode(d)) is None else hashlib.sha256(np.asarray(x, np.float32).tobytes() + str(x.shape).encode()).hexdigest() for d in batch])

    digest.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    pixel = F.pandas_udf(digest, "string")
    rows = images.select(F.col(f"`{key}`").cast("long").alias("_id"), F.col(f"`{data}`").alias("_data")).withColumn("_pixels", pixel("_data"))
    narrow = saved(rows.select("_id", "_pixels"), "pixels")
    classes = narrow.where("_id is not null and _pixels is not null").groupBy("_pixels").agg(F.min("_id").alias("class_id"), F.min(F.when(F.col("_id") % every == 0, F.col("_id"))).alias("_asked"))
    classes = saved(classes, "classes")
    every_image = rows.select("_id", "_data").where("_id is not null and _data is not null")
    index = every_image.join(classes.select(F.col("class_id").alias("_id")), "_id", "left_semi").dropDuplicates(["_id"])
    # Pictures are few bytes and much work: their tasks are named, so that they are not merged by size.
    index = saved(described(index.repartition(partitions(images.sparkSession), F.xxhash64("_id")), decode), "descriptors")
    asked = every_image.join(classes.where("_asked is not null").select(F.col("_asked").alias("_id")), "_id", "left_semi").dropDuplicates(["_id"])
    asked = saved(described(asked, lambda d: None if (x := decode(d)) is None else alter(x)), "asked")
    found = matched_images(asked, index)
    best = (
        found.join(classes.select(F.col("_asked").alias("query"), F.col("class_id").alias("_own")), "query")
        .groupBy("query")
        .agg(
            F.count(F.lit(1)).alias("n_links"),
            F.max(F.col("image") == F.col("_own")).alias("own_found"),
            F.max(F.when(F.col("image") != F.col("_own"), F.struct("inliers", (-F.col("image")).alias("image")))).alias("_best"),
        )
    )
    corners = index.select(F.col("_id").alias("class_id"), F.col("_n").alias("n_corners"))
    per_class = classes.join(corners, "class_id", "left").join(best.withColumnRenamed("query", "_asked"), "_asked", "left")
    asked_row = F.col("_id").isNotNull() & (F.col("_id") % every == 0)
    per_class = per_class.select("_pixels", "class_id", "n_corners", "n_links", "own_found", "_best")
    out = narrow.join(per_class, "_pixels", "left")
    own = lambda c: F.when(asked_row & F.col("class_id").isNotNull(), c)
    return out.select(
        F.col("_id").alias(key),
        F.when(F.col("_id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.coalesce("n_corners", F.lit(0)).cast("long").alias("n_corners"),
        F.coalesce(asked_row, F.lit(False)).alias("is_query"),
        own(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        own(F.coalesce("own_found", F.lit(False))).alias("own_found"),
        own(-F.col("_best.image")).alias("best_match"),
        own(F.col("_best.inliers")).cast("long").alias("best_inliers"),
    )


def vector_image(vector, side: int = 64) -> np.ndarray | None:
    """Gray image of a vector: a square of its values, smoothly enlarged and stretched to 0 to 255. Null, short and flat ones: none."""
    if vector is None or len(vector) < 4:
        return None
    v = np.asarray(vector, float)
    v = np.where(np.isfinite(v), v, 0.0)
    edge = int(np.sqrt(len(v)))
    low, high = v.min(), v.max()
    if high <= low:
        return None
    grid = ((v[: edge * edge] - low) / (high - low) * 255).reshape(edge, edge)
    return np.round(resize(grid, side, side))


def cropped(image: np.ndarray) -> np.ndarray:
    """An edited copy: a border cut off, darkened, with less contrast."""
    h, w = image.shape
    return np.round(image[h // 16 :, w // 10 :] * 0.8 + 12)
