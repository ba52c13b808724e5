"""Document fingerprints by order min-hash: they tell texts apart by edits, order included.

A text's k-mers are runs of words, numbered by occurrence. A hash deals them to bins and orders each bin; the
smallest few of a bin, put back into text order, are hashed as a tuple. Texts agree in a bin if the same k-mers are
smallest there and stand in the same order. Everything is a column expression; a text is never unfolded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cohortgrid.llm.common import let

KMER = 2  # words
BINS = 64  # a power of two
TUPLE = 2  # k-mers of a bin that are kept
SPACE = "[\\x20\\x09-\\x0D]+"
PLACE_BITS = 31


def _k_mers(text: Column) -> Column:
    """Hashes of the k-mers in text order; of all words if they are fewer; none without words."""

    def run(words: Column) -> Column:
        count = F.size(words) - (KMER - 1)
        runs = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(KMER)]))
        return F.when(count > 0, runs).when(F.size(words) > 0, F.array(F.xxhash64(words))).otherwise(F.array().cast("array<long>"))

    hashed = F.transform(F.split(text, SPACE), lambda w: F.when(w != "", F.xxhash64(w)))
    return let(F.array_compact(hashed), run)


def _place(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << PLACE_BITS) - 1))


def _head(packed: Column) -> Column:
    return F.shiftright(packed, PLACE_BITS)


def _pack(hashed: Column, place: Column) -> Column:
    """32 bits of a hash above a place: sorts by hash, then by place."""
    return F.shiftleft(F.shiftrightunsigned(hashed, 32), PLACE_BITS).bitwiseOR(place.cast("long"))


def _numbered(kmers: Column) -> Column:
    """For each k-mer occurrence, packed: the hash of the k-mer with its occurrence number, and its place."""

    def run(ordered: Column) -> Column:
        def first_of_run(i: Column) -> Column:
            """Where in the sorted array the run of equal k-mers that holds i begins: by halving."""
            steps = F.sequence(F.lit(1), F.lit(PLACE_BITS))
            start = F.struct(F.lit(0).alias("low"), i.alias("high"))

            def halve(s: Column, _: Column) -> Column:
                middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
                below = _head(F.get(ordered, middle)) < _head(F.get(ordered, i))
                return F.when(s["low"] >= s["high"], s).otherwise(
                    F.struct(F.when(below, middle + 1).otherwise(s["low"]).alias("low"), F.when(below, s["high"]).otherwise(middle).alias("high"))
                )

            return F.aggregate(steps, start, halve, lambda s: s["low"])

        def number(packed: Column, i: Column) -> Column:
            alone = (i == 0) | (_head(F.get(ordered, i - 1)) != _head(packed))
            return _pack(F.xxhash64(_head(packed), F.when(alone, F.lit(0)).otherwise(i - first_of_run(i))), _place(packed))

        return F.transform(ordered, number)

    return let(F.sort_array(F.transform(kmers, lambda h, i: _pack(h, i))), run)


def fingerprint(text: Column) -> Column:
    """array<int> of BINS; null where a bin has no k-mer. Equal texts have equal fingerprints; a null text has an empty one's."""
    bits = BINS.bit_length() - 1

    def bin_of(packed: Column) -> Column:
        return F.shiftright(packed, PLACE_BITS + 32 - bits)

    def build(kmers: Column) -> Column:
        def smallest(ordered: Column) -> Column:
            kept = F.filter(ordered, lambda p, i: (i < TUPLE) | (bin_of(F.get(ordered, i - TUPLE)) != bin_of(p)))
            # Back to text order within a bin: bin above place.
            return F.sort_array(F.transform(kept, lambda p: F.shiftleft(bin_of(p), PLACE_BITS).bitwiseOR(_place(p))))

        def tuples(kept: Column) -> Column:
            def from_here(p: Column, i: Column) -> Column:
                own = [F.get(kept, i + j) for j in range(TUPLE)]
                mers = [F.when(_head(x) == _head(p), F.get(kmers, _place(x).cast("int"))) for x in own]
                return F.struct(_head(p).alias("bin"), F.shiftright(F.xxhash64(*mers), 32).cast("int").alias("hash"))

            return let(
                F.transform(kept, from_here),
                lambda every: F.filter(every, lambda t, i: (i == 0) | (F.get(every, i - 1)["bin"] != t["bin"])),
            )

        return let(let(F.sort_array(_numbered(kmers)), smallest), tuples)

    found = let(_k_mers(F.coalesce(text, F.lit(""))), build)

    def spread(tuples: Column) -> Column:
        by_bin = F.map_from_entries(tuples)
        return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.try_element_at(by_bin, b.cast("long")))

    return let(found, spread)


def likeness(a: Column, b: Column) -> Column:
    """Share of the bins that agree, of those that either has; 1 if neither has any."""
    pairs = F.zip_with(a, b, lambda x, y: F.when(x.isNull() & y.isNull(), F.lit(None)).otherwise(F.coalesce(x == y, F.lit(False)).cast("int")))
    return let(F.array_compact(pairs), lambda p: F.when(F.size(p) == 0, F.lit(1.0)).otherwise(F.aggregate(p, F.lit(0), lambda s, x: s + x) / F.size(p)))


def as_text(mark: Column) -> Column:
    return F.array_join(F.transform(mark, lambda x: F.coalesce(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), F.lit("-"))), ".")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, ...) and next_<column>: the document next in descending doc_id; after the last, the first.

    Rows go to ranges of doc_id; the first row of each range is also put at the end of the range before it, so each
    range knows its rows' successors. Equal doc_ids stand in the order of their columns' hash, null is last.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.col("doc_id").cast("double").alias("x"))
    cuts = sorted(set(ids.approxQuantile("x", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    # Ranges count down, so that they follow one another in descending order; null goes to the last.
    last = len(cuts)
    bounds = F.array(*[F.lit(c) for c in cuts]) if cuts else F.array().cast("array<double>")
    below = F.aggregate(bounds, F.lit(0), lambda n, c: n + (c < F.col("doc_id").cast("double")).cast("int"))
    ranged = docs.withColumns(
        {"_range": F.when(F.col("doc_id").isNull(), F.lit(last)).otherwise(last - below), "_tie": F.xxhash64(*columns)}
    )
    tops = {r["_range"]: r["top"] for r in ranged.groupBy("_range").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    homes = {at: order[i - 1] for i, at in enumerate(order)}  # the first range's head stands behind the last
    heads = F.create_map(*[F.lit(x) for at in order for x in (at, homes[at])]) if order else F.create_map().cast("map<int,int>")
    of_range = F.create_map(*[F.lit(x) for at in order for x in (at, tops[at])]) if order else F.create_map().cast("map<int,bigint>")
    is_head = F.col("doc_id").eqNullSafe(F.try_element_at(of_range, "_range"))
    copies = F.when(is_head, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    laid = ranged.withColumn("_copy", F.explode(copies)).withColumn(
        "_range", F.when(F.col("_copy"), F.try_element_at(heads, "_range")).otherwise(F.col("_range"))
    )
    line = Window.partitionBy("_range").orderBy("_copy", F.desc_nulls_last("doc_id"), "_tie")
    laid = laid.withColumns({f"next_{c}": F.lead(c).over(line) for c in columns})
    return laid.where("NOT _copy").drop("_range", "_tie", "_copy")


def compared_with_edits(documents: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next), a row for each document.

    edited: the last third of the text replaced by as many first code points of the next document's (or all of them).
    Null is an empty text. A text with fewer words than a k-mer has one k-mer, an empty one none; two
    empty fingerprints are alike. Other columns are ignored.
    """
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("mark", fingerprint(F.col("text")))
    paired = with_next(docs, ["text", "mark"])
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    paired = paired.select("doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "mark", "next_mark")
    paired = paired.withColumn("edited_mark", fingerprint(F.col("edited")))
    return paired.select(
        "doc_id",
        "n_chars",
        "text",
        "edited",
        as_text(F.col("mark")).alias("fingerprint"),
        as_text(F.col("edited_mark")).alias("edited_fingerprint"),
        likeness(F.col("mark"), F.col("edited_mark")).alias("near_edited"),
        likeness(F.col("mark"), F.col("next_mark")).alias("near_next"),
    )
