"""Benchmark passages in documents: windows of item words, found by their rarest shingle and then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cohortgrid.llm.common import LOWER, UPPER, let, small, text_key, written

SHINGLE = 3  # words that are joined at once; a shorter window is one shingle
APART = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"  # what stands between words


def words_of(text: Column) -> Column:
    """Letters, digits and all beyond ASCII, A-Z in lower case; null has no words."""
    text = F.coalesce(text, F.lit(""))
    plain = F.octet_length(text) == F.length(text)
    low = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(low, APART), "")


def _maybe_broadcast(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if small(df) else df


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item_id, window, size): runs of so many words of each item, the whole of a shorter one."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words"))
    items = items.where("item_id IS NOT NULL AND size(words) > 0")
    count = F.greatest(F.size("words") - (window - 1), F.lit(1))
    starts = F.transform(F.sequence(F.lit(1), count), lambda i: F.slice("words", i, window))
    spread = items.select("item_id", F.explode(starts).alias("words"))
    return spread.select("item_id", F.array_join("words", " ").alias("window"), F.size("words").alias("size")).distinct()


def shingles(words: Column, width: int) -> Column:
    """Hashes of each width words in a row."""
    count = F.size(words) - (width - 1)
    starts = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(width)]))


def _probes(texts: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """(window, size, width, shingle, offset): the rarest shingle of each window that can occur."""
    parts = None
    for width in widths:
        own = windows.where(F.least("size", F.lit(SHINGLE)) == width)
        hashes = let(F.split("window", " "), lambda ws: shingles(ws, width))
        own = own.select("window", "size", F.lit(width).alias("width"), F.posexplode(hashes).alias("offset", "shingle"))
        listed = _maybe_broadcast(written(own.select("shingle").distinct()))
        spoken = texts.select(F.explode(let(words_of(F.col("text")), lambda ws: shingles(ws, width))).alias("shingle"))
        counts = written(spoken.join(listed, "shingle").groupBy("shingle").agg(F.count("*").alias("n")))
        own = own.join(_maybe_broadcast(counts), "shingle", "left")
        parts = own if parts is None else parts.unionByName(own)
    if parts is None:
        return windows.selectExpr("window", "size", "1 AS width", "0L AS shingle", "0 AS offset")
    # A shingle that no document has rules its window out.
    probes = parts.groupBy("window", "size", "width").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset")).alias("rarest")
    )
    return probes.where("rarest.n > 0").select("window", "size", "width", "rarest.shingle", "rarest.offset")


def contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), a row for each document.

    A window is so many consecutive words of an item, or all of a shorter one; a document word inside any
    occurrence of a window is hit. A window can occur only where its rarest shingle does, so that shingle, by its
    count over all documents, is all that is joined; where it stands gives the window's place, which must lie
    within the document, and there the words are compared. Null and empty texts have no words and no hits. Items
    that repeat, or share windows, count once by their id; an item without id or words is ignored. Documents with
    equal texts are searched once. Other columns are ignored.
    """
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = _found(texts, benchmark, window)
    key = text_key(F.col("text"))
    counted = texts.select("doc_id", key["d1"].alias("d1"), key["d2"].alias("d2"), _word_count().alias("n_words"))
    items = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(found, ["d1", "d2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
    )


def without_contaminated(documents: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The rows of documents whose text holds no occurrence of a window, as contaminated() finds them; judged by the
    text, whatever the id. All columns stay."""
    text = F.coalesce("text", F.lit(""))
    hit = written(_found(documents.select(text.alias("text")), benchmark, window).select("d1", "d2"))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")  # keeps all names apart
    keyed = documents.select(row, *[key.alias(name) for name, key in text_key(text).items()])
    return keyed.join(_maybe_broadcast(hit), ["d1", "d2"], "left_anti").select("row.*")


def _found(texts: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """(d1, d2, n_hit, items) of the texts in which windows occur."""
    key = text_key(F.col("text"))
    windows = written(benchmark_windows(benchmark, window))

    widths = [r[0] for r in windows.select(F.least("size", F.lit(SHINGLE))).distinct().collect()]  # SHINGLE numbers at most
    probes = written(_probes(texts, windows, widths))
    places = None
    for width in widths:
        at = texts.select(
            key["d1"].alias("d1"),
            key["d2"].alias("d2"),
            let(words_of(F.col("text")), lambda ws: F.struct(F.size(ws).alias("n"), shingles(ws, width).alias("all"))).alias("w"),
        ).select("d1", "d2", "w.n", F.posexplode("w.all").alias("pos", "shingle"))
        met = at.join(_maybe_broadcast(probes.where(F.col("width") == width)), "shingle")
        met = met.where("pos >= offset AND pos - offset + size <= n")
        met = met.select("d1", "d2", F.struct((F.col("pos") - F.col("offset")).alias("start"), "size", "window").alias("place"))
        places = met if places is None else places.unionByName(met)
    if places is None:  # no item has words
        places = windows.select(
            F.lit(0).cast("long").alias("d1"),
            F.lit(0).cast("long").alias("d2"),
            F.struct(F.lit(0).alias("start"), "size", "window").alias("place"),
        )
    places = written(places.groupBy("d1", "d2").agg(F.collect_set("place").alias("places")))

    keyed = texts.withColumns(key)
    searched = keyed.join(_maybe_broadcast(places.select("d1", "d2")), ["d1", "d2"], "left_semi")
    searched = searched.groupBy("d1", "d2").agg(F.first("text").alias("text")).join(places, ["d1", "d2"])

    def stands(words: Column) -> Column:
        return F.filter("places", lambda p: F.array_join(F.slice(words, p["start"] + 1, p["size"]), " ") == p["window"])

    hits = let(words_of(F.col("text")), stands)
    found = written(searched.select("d1", "d2", hits.alias("hits")).where("size(hits) > 0"))

    covered = F.array_distinct(
        F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["size"] - 1)))
    )
    hit_words = found.select("d1", "d2", F.size(covered).cast("long").alias("n_hit"))
    occurring = found.select("d1", "d2", F.explode("hits.window").alias("window")).distinct()
    items = occurring.join(_maybe_broadcast(windows.select("item_id", "window")), "window")
    items = items.groupBy("d1", "d2").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    return hit_words.join(items, ["d1", "d2"])


def _word_count() -> Column:
    return F.size(F.array_remove(F.split("text", APART), "")).cast("long")
