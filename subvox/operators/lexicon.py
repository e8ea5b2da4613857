"""Words and phones: dictionaries, lookups and nearest words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from subvox.functions.fixed import BASE_LEXICON, PHONE_PATTERN, PHONES
from subvox.functions.text import normalize_word
from subvox.plans.joins import spread_join
from subvox.session import cut_lineage


def base_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BASE_LEXICON.items()), "word string, phones array<string>")


def read_pronunciations(spark: SparkSession, path: str) -> DataFrame:
    """Pronouncing dictionary text: comments skipped, variants and stress dropped, first entry kept."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.monotonically_increasing_id().alias("at"))
    parts = F.split("line", r"\s+")
    rows = lines.where((F.col("line") != "") & ~F.startswith("line", F.lit(";;;")) & (F.size(parts) >= 2))
    phones = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda p: F.regexp_replace(F.upper(p), "[0-9]", ""))
    known = F.filter(phones, lambda p: p.isin(PHONES[1:]))
    entries = rows.select(F.lower(F.regexp_replace(parts[0], r"\(\d+\)$", "")).alias("word"), known.alias("phones"), "at")
    return entries.where(F.size("phones") > 0).groupBy("word").agg(F.min_by("phones", "at").alias("phones"))


def _variants(key: Column) -> list[Column]:
    return [key, F.replace(key, F.lit("-"), F.lit(" ")), F.replace(key, F.lit("-"), F.lit(""))]


def look_up(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """``word, phones`` of each distinct word; null phones where there is no way to say it.

    Tried in order: the normalised word, its hyphens as spaces, without hyphens; then its
    parts one by one, joined; then spelling of words of up to three letters.
    """
    distinct = words.select(F.col(word).alias("word")).distinct().withColumn("_k", normalize_word(F.col("word")))
    entries = lexicon.select(F.col("word").alias("_e"), F.col("phones").alias("_p"))

    def find(df: DataFrame, id_cols: list[str], key: str) -> DataFrame:
        tries = df.select(*id_cols, F.posexplode(F.array(*_variants(F.col(key)))).alias("_n", "_e"))
        hits = tries.join(entries, "_e")
        return hits.groupBy(*id_cols).agg(F.min_by("_p", "_n").alias("_found"))

    def spelled(key: Column) -> Column:
        letters = F.filter(F.split(F.upper(key), ""), lambda p: p.isin(PHONES[1:]))
        return F.when((F.length(key) <= 3) & key.rlike("^[a-z]+$") & (F.size(letters) > 0), letters)

    whole = distinct.join(find(distinct, ["word"], "_k"), "word", "left")
    missing = whole.where("_found IS NULL")
    several = missing.where(F.col("_k").rlike("[ -]"))
    parts = several.select("word", F.posexplode(F.split("_k", r"[\s\-]+")).alias("_i", "_part")).where("_part <> ''")
    found = parts.join(find(parts, ["word", "_i"], "_part"), ["word", "_i"], "left")
    found = found.withColumn("_found", F.coalesce("_found", spelled(F.col("_part")))).where("_found IS NOT NULL")
    joined = found.groupBy("word").agg(F.flatten(F.sort_array(F.collect_list(F.struct("_i", "_found")))["_found"]).alias("_joined"))
    out = whole.join(joined, "word", "left")
    single = F.when(~F.col("_k").rlike("[ -]"), spelled(F.col("_k")))
    return out.select("word", F.coalesce("_found", "_joined", single).alias("phones"))


def overlay(base: DataFrame, user: DataFrame) -> DataFrame:
    """User entries over base entries: words lower-cased, phones upper-cased, empty phones dropped."""
    mine = user.select(
        F.lower(F.trim("word")).alias("word"),
        F.filter(F.transform("phones", lambda p: F.upper(F.trim(p))), lambda p: p != "").alias("_mine"),
    )
    both = base.select(F.lower("word").alias("word"), F.col("phones").alias("_base")).join(mine, "word", "full")
    return both.select("word", F.coalesce("_mine", "_base").alias("phones"))


def validate_lexicon(lexicon: DataFrame) -> DataFrame:
    """``word, issue, phone``: empty phone lists and malformed phones."""
    bad = F.filter("phones", lambda p: ~p.rlike(PHONE_PATTERN))
    empty = F.array(F.struct(F.lit("empty phone list").alias("issue"), F.lit(None).cast("string").alias("phone")))
    listed = F.transform(bad, lambda p: F.struct(F.lit("invalid phone").alias("issue"), p.alias("phone")))
    found = F.when(F.size("phones") == 0, empty).otherwise(listed)
    return lexicon.select("word", F.explode(found).alias("i")).select("word", "i.issue", "i.phone")


def phones_of(words: DataFrame, lexicon: DataFrame, word: str = "word") -> DataFrame:
    """Adds ``phones``; a word outside the lexicon is one phone ``@word``."""
    key = F.lower(F.trim(F.col(word)))
    entries = lexicon.select(F.col("word").alias("_k"), "phones")
    out = spread_join(words.withColumn("_k", key), entries, ["_k"], "left", salt_by=words.columns[:3])
    return out.withColumn("phones", F.coalesce("phones", F.array(F.concat(F.lit("@"), "_k")))).drop("_k")


def phone_inventory(labels: DataFrame, lexicon: DataFrame, label: str = "label") -> DataFrame:
    """Distinct phones a label set needs."""
    distinct = labels.select(F.col(label).alias("word")).distinct()
    return phones_of(distinct, lexicon).select(F.explode("phones").alias("phone")).distinct()


def phone_code(phones: Column) -> Column:
    """Phones as a string of one letter each, so edit distance is a built-in."""
    pairs = [x for i, p in enumerate(PHONES) for x in (F.lit(p), F.lit(chr(48 + i)))]
    table = F.create_map(*pairs)
    return F.array_join(F.filter(F.transform(phones, lambda p: table[p]), lambda c: c.isNotNull()), "")


def _piece(number: Column, length: Column, count: Column) -> tuple[Column, Column]:
    """Start (from 0) and size of a piece of a word of ``length`` cut into ``count`` pieces."""
    start = F.floor(number * length / count).cast("int")
    return start, (F.floor((number + 1) * length / count) - start).cast("int")


def _met(strings: DataFrame, words: DataFrame, distance: int, sizes: dict[int, int]) -> DataFrame:
    """Pairs of a string and a word that may be ``distance`` apart or less: ``code, word, rank, _d`` (-1: they are not).

    A word in ``distance + 1`` pieces keeps one of them whole in any string so near, at a place that the errors before and
    after it allow. A word with fewer characters than that keeps one character, or none at all. Where a length has
    no more words than a string would have pieces for it, the string meets those words themselves.
    """
    few = [n for n, count in sizes.items() if count <= (distance + 1) ** 2]
    whole = F.col("_len").isin(few) if few else F.lit(False)
    count = F.least(F.lit(distance + 1), F.col("_len"))
    numbers = F.when(whole, F.array(F.lit(-1))).when(F.col("_len") > 0, F.sequence(F.lit(0), count - 1))
    start, size = _piece(F.col("_no"), F.col("_len"), count)

    def text(of: str, place: Column) -> Column:
        return F.when(F.col("_no") < 0, F.lit("")).otherwise(F.substring(F.col(of), place + 1, size))

    indexed = words.withColumn("_no", F.explode(numbers)).select("word", "rank", "_c", "_len", "_no", text("_c", start).alias("_text"))
    lengths = F.array(*[F.lit(n) for n in sorted(sizes)])
    asked = strings.select("code", F.explode(F.filter(lengths, lambda n: F.abs(n - F.length("code")) <= distance)).alias("_len"))
    asked = asked.withColumn("_no", F.explode(numbers))
    delta, before, after = F.length("code") - F.col("_len"), F.col("_no"), F.lit(distance) - F.col("_no")
    in_pieces = F.col("_len") > distance
    low = F.when(in_pieces, F.greatest(start - before, start + delta - after)).otherwise(start - distance)
    high = F.when(in_pieces, F.least(start + before, start + delta + after)).otherwise(start + distance)
    low, high = F.greatest(low, F.lit(0)), F.least(high, F.length("code") - size)
    places = F.when(F.col("_no") < 0, F.array(F.lit(0))).when(low <= high, F.sequence(low, high))
    asked = asked.withColumn("_at", F.explode(places)).select("code", "_len", "_no", text("code", F.col("_at")).alias("_text")).distinct()
    return asked.join(indexed, ["_len", "_no", "_text"]).select("code", "word", "rank", F.levenshtein("code", "_c", distance).alias("_d"))


def nearest_words(hyps: DataFrame, lexicon: DataFrame, first: int | None = None) -> DataFrame:
    """``code, word, distance``: closest lexicon word of each distinct string ``code`` by edit distance.

    ``lexicon(word, code, rank)``: equal strings win, then the smallest distance, then the lowest rank. Null and empty strings
    have no row, an empty lexicon gives none. Exact hits leave by an equi join; the others are looked for within a
    distance that doubles from round to round (from ``first`` on), by joins on pieces of words. A string leaves as soon as its
    best word is within the round's distance. The word of lowest rank that is not longer than the string, or of the least length,
    bounds the distance from the start, and is the answer where no character can be kept.
    """
    distinct = hyps.select("code").distinct()
    known = lexicon.where("code is not null").groupBy("code").agg(F.min("rank").alias("rank"), F.min_by("word", "rank").alias("word"))
    exact = distinct.join(known, "code").select("code", "word", F.lit(0).alias("distance"))
    words = known.select("word", "rank", F.col("code").alias("_c"), F.length("code").alias("_len"))
    # One row per length of a word.
    table = sorted(words.groupBy("_len").agg(F.count(F.lit(1)), F.min(F.struct("rank", "word", "_c"))).collect())
    if not table:
        return exact
    sizes = {n: count for n, count, _ in table}
    lowest = [(n, min(row for m, _, row in table if m <= n)) for n in sizes]
    bounds = F.array(*[F.struct(F.lit(n).alias("n"), F.lit(r.rank).alias("rank"), F.lit(r.word).alias("word"), F.lit(r._c).alias("c")) for n, r in lowest])
    limit = F.greatest(F.length("code"), F.lit(min(sizes)))
    rest = distinct.join(known, "code", "left_anti").where("code <> ''")
    rest = rest.withColumn("_a", F.element_at(F.filter(bounds, lambda b: b["n"] <= limit), -1))
    best = F.struct(F.levenshtein("code", "_a.c").alias("d"), F.col("_a.rank").alias("rank"), F.col("_a.word").alias("word"))
    waiting = cut_lineage(rest.select("code", best.alias("_best")))
    distance, total = first or 2, sum(sizes.values())
    while first is None and distance < 16 and total <= 4 * (distance + 1) ** 2:  # so few words are met at once
        distance *= 2
    out = exact
    while True:
        near = _met(waiting, words, distance, sizes).where("_d >= 0")
        near = near.groupBy("code").agg(F.min(F.struct(F.col("_d").alias("d"), "rank", "word")).alias("_near"))
        found = waiting.join(near, "code", "left").select("code", F.least("_best", F.coalesce("_near", "_best")).alias("_best"))
        found = cut_lineage(found)
        done = found.where(F.col("_best.d") <= distance)
        out = out.unionByName(done.select("code", F.col("_best.word").alias("word"), F.col("_best.d").alias("distance")))
        waiting = found.where(F.col("_best.d") > distance)
        if not waiting.limit(1).count():
            return out
        distance *= 2
