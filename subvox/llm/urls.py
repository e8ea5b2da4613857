"""URL filters: a blocked Bloom filter of listed canonical URLs in front of an exact hash join.

A rule is a canonical URL, host and path without query (``example.net/en/``). It fits its host and all subdomains, where the path of
the URL starts with the rule's path. The rules' hosts, and hosts with paths, go into one Bloom filter whose blocks are eight
64-bit words; a key sets one bit in each word of one block. The filter reaches the tasks as a scalar subquery of at most ``MAX_BLOCKS``
blocks (4 MB). A longer list only raises the share of false hits, since whatever passes is joined with the rules themselves.

Main path: DataFrame functions only. URLs no suffix of whose host is in the filter meet no join and no shuffle. The others are joined by host
and the first characters of the path that a rule can tell apart, made distinct first, so that a host with a third of all rows is looked up once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subvox.llm.common import saved

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8
#: Bits of the filter per key, and blocks of 512 bits at most.
BITS = 16
MAX_BLOCKS = 1 << 16
OUT = ("host", "path", "rule", "verdict")


#: Host and path after the first ``://``.
PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/ ? #`` or the end, A-Z in lower case; empty without ``://`` and for null."""
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``? #`` or the end; empty without ``://`` and for null."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with columns added that later filters and projections do not work out again."""
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return rows.select("*", F.explode(F.array(made)).alias("_made")).select(*rows.columns, *[F.col(f"_made.{n}").alias(n) for n in columns])


class Rules:
    """Rules of ``rules`` (``rule`` string, ``verdict`` string) and their filter.

    Rules without a ``/`` or a host, and null ones, fit nothing. A rule listed with several verdicts has the greatest by code point,
    which is ``block`` of the two. An empty table gives rules that fit no URL.
    """

    def __init__(self, rules: DataFrame, *, max_blocks: int = MAX_BLOCKS):
        at = F.instr("rule", "/")
        parts = rules.select(F.col("rule").cast("string").alias("rule"), F.col("verdict").cast("string").alias("verdict")).where(at > 1)
        listed = parts.select(
            F.translate(F.substring("rule", F.lit(1), at - 1), UPPER, LOWER).alias("_host"),
            F.substring("rule", at, F.length("rule")).alias("_path"), "verdict",
        )
        self.table = saved(listed.groupBy("_host", "_path").agg(F.max("verdict").alias("_verdict")), "rules")
        # Shape of the list: how many rules, of how many labels the hosts are, how long the paths are.
        labels = F.size(F.split("_host", r"\.", -1))
        shape = self.table.agg(F.count(F.lit(1)), F.collect_set(labels), F.collect_set(F.length("_path"))).first()
        self.count, self.labels, self.lengths = shape[0], sorted(shape[1]), sorted(shape[2])
        self.blocks = max(1, min(max_blocks, -(-2 * self.count * BITS // (64 * WORDS))))
        self.words = saved(self._words(), "filter").scalar()

    def _words(self) -> DataFrame:
        """One row: the words of all blocks in one array."""
        keys = self.table.select(F.xxhash64("_host").alias("_h")).unionByName(self.table.select(F.xxhash64("_host", "_path").alias("_h")))
        set_ = keys.groupBy(self._block(F.col("_h")).alias("_block")).agg(*[F.bit_or(_bit(F.col("_h"), i)).alias(f"_w{i}") for i in range(WORDS)])
        every = self.table.sparkSession.range(self.blocks).select(F.col("id").alias("_block")).join(set_, "_block", "left")
        words = F.array(*[F.coalesce(F.col(f"_w{i}"), F.lit(0).cast("long")) for i in range(WORDS)])
        return every.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("_block", words.alias("_w")))), lambda b: b["_w"])).alias("_words"))

    def _block(self, key: Column) -> Column:
        return F.pmod(F.shiftright(key, 16), F.lit(self.blocks).cast("long"))

    def block(self, key: Column) -> Column:
        """The words of the one block that a hashed key may be in."""
        return F.slice(self.words, (self._block(key) * WORDS).cast("int") + 1, WORDS)


def may_hold(block: Column, key: Column) -> Column:
    """Whether a block has all bits of a hashed key: true for all listed ones, and rarely for others."""
    found = F.lit(True)
    for i in range(WORDS):
        bit = _bit(key, i)
        found = found & (F.element_at(block, i + 1).bitwiseAND(bit) == bit)
    return found


def _bit(key: Column, word: int) -> Column:
    """One of 64 bits per word, from a second hash of the key."""
    two = F.xxhash64(key, F.lit(word // 4))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(two, 8 * (word % 4)).bitwiseAND(F.lit(63).cast("long")).cast("int"))


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", *, keep: tuple[str, ...] | None = None, default: str = "allow", max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The columns ``keep`` (default: all) of ``pages`` with ``host, path, rule, verdict`` added: one row per row.

    ``rule`` is the longest rule that fits (of equally long ones the one with the longer host), as ``host/path``; null where none does, and then the
    verdict is ``default``. A null or empty URL, or one without ``://``, has empty host and path and fits no rule. Repeated rows
    are judged alike, each for itself; URLs of any length are taken whole. Columns of ``pages`` that bear the name of an added one are left out. Empty
    tables of pages give no rows, an empty table of rules the default for all.
    """
    listed = Rules(rules, max_blocks=max_blocks)
    names = [c for c in (keep or pages.columns) if c.lower() not in OUT]
    address = F.col(f"`{url}`").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.struct(F.lit(0))
    rows = _once(pages.select(row.alias("_row"), address.alias("_url")), host=host_of(F.col("_url")), path=path_of(F.col("_url"))).drop("_url")
    ends = [F.substring_index("host", ".", -n) for n in listed.labels]
    blocks = rows.select("*", *[listed.block(F.xxhash64(end)).alias(f"_b{i}") for i, end in enumerate(ends)])
    hits = [F.when((F.length("host") > 0) & may_hold(F.col(f"_b{i}"), F.xxhash64(end)), end) for i, end in enumerate(ends)]
    held = F.array_distinct(F.array_compact(F.array(*hits))) if hits else F.array().cast("array<string>")
    rows = _once(blocks, _hosts=held).select("_row", "host", "path", "_hosts")
    shown = [F.col(f"_row.`{c}`").alias(c) for c in names]
    free = rows.where(F.size("_hosts") == 0).select(*shown, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    # What decides: the host, and as much of the path as the longest rule can ask for.
    open_ = rows.where(F.size("_hosts") > 0).withColumn("_start", F.substring("path", 1, max(listed.lengths, default=0)))
    asked = open_.select("host", "_start", "_hosts").distinct().select("host", "_start", F.explode("_hosts").alias("_host"))
    asked = asked.select("*", F.explode(F.array(*[F.lit(n) for n in listed.lengths]).cast("array<int>")).alias("_n")).where(F.col("_n") <= F.length("_start"))
    asked = asked.select("host", "_start", "_host", F.substring("_start", F.lit(1), F.col("_n")).alias("_path"))
    asked = _once(asked.withColumn("_hash", F.xxhash64("_host", "_path")), _block=listed.block(F.col("_hash")))
    possible = asked.where(may_hold(F.col("_block"), F.col("_hash"))).select("host", "_start", "_host", "_path")
    size = F.length("_host") + F.length("_path")
    exact = possible.join(listed.table, ["_host", "_path"])
    best = exact.groupBy("host", "_start").agg(F.max(F.struct(size.alias("_size"), F.length("_host").alias("_wide"), F.concat("_host", "_path").alias("rule"), "_verdict")).alias("_best"))
    met = open_.join(best, ["host", "_start"], "left")
    return free.unionByName(met.select(*shown, "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best._verdict", F.lit(default)).alias("verdict")))


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", **options) -> DataFrame:
    """The rows of ``pages``, whole, whose URL is not blocked."""
    held = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_page"), F.col(f"`{url}`").alias("_url"))
    return judge(held, rules, "_url", keep=("_page",), **options).where("verdict <> 'block'").select("_page.*")
