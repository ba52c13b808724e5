"""Personal data: patterns for four kinds, and contexts that they teach.

What the kinds' own patterns find are seeds. The words around seeds are context patterns; other tokens with digits
or an @ in those places are candidates. Spark scores the graph of contexts and tokens in turns: a context is as good as
what it holds of a kind outweighs what it holds that is nothing personal. Candidates that could be of the kind and are
not known yet count on neither side, for they are what the context is to find. Tokens that good contexts vouch for
join the spans.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cohortgrid.llm.common import slices, small, text_key, written

KINDS = ("email", "ip", "card", "phone")
ROWS = 512  # texts whose spans are in memory at once
FOUND = 50_000  # candidates that are held before they are handed on
SUPPORT = 5  # different believed tokens of a kind that a context needs, or tokens of no kind to refute the others
TRUST = 0.9  # share that a context's believed tokens must have beside its tokens of no kind, or these beside its seeds

LOCAL = "A-Za-z0-9._%+-"
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
EMAIL = re.compile(rf"[{LOCAL}]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A dotted number can only start where its digits do: a later digit would meet the same end.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Groups of digits as PHONE and CARD join them, that neither begin nor end inside a word.
RUN = re.compile(r"(?<![\w@+.-])\(?[0-9]+(?:[\x20().-]+[0-9]+)+(?![\w@])")
LONG_WORD = 64  # characters of a context's word that stand for themselves
MARK = re.compile(r"[0-9@]")
OTHERS = re.compile(r"[^0-9]+")
CARD_BIT = 1 << KINDS.index("card")
DOUBLED = str.maketrans("0123456789", "0246813579")  # each digit's double, its own digits summed
PIECE = re.compile(r"[^\x20]+")
TOKEN_END = re.compile(r"\s|\Z")
#: Punctuation that may stand around a token without being part of it; a + may begin one.
AROUND = frozenset("!\"#$%&'()*,-./:;<=>?[\\]^_`{|}~…–—“”„«»‘’")
#: How many digits a candidate of a kind may have; an email must have an @ instead.
DIGITS = {"ip": (4, 12), "card": (12, 19), "phone": (7, 15)}
MOST, LEAST = 19, 7  # digits of any kind; digits that a piece of a run needs to teach by itself

SPAN = "struct<start:int,kind:int,stop:int>"
CANDIDATE = "struct<start:int,stop:int,token:string,kind:int,kinds:int,counts:int,contexts:array<string>>"


def luhn(digits: str) -> bool:
    backwards = digits[::-1]
    return (sum(map(int, backwards[::2])) + sum(map(int, backwards[1::2].translate(DOUBLED)))) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What EMAIL finds from left to right, looked for around each @ only."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = max(done, at)
        while begin > done and text[begin - 1] in LOCAL_CHARS:
            begin -= 1
        found = EMAIL.match(text, begin) if begin < at else None
        if found:
            yield found.span()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, stop) in code points, kind by its place in KINDS, sorted; leftmost, without overlap in a kind."""
    spans = [(a, 0, b) for a, b in _emails(text)]
    if not MARK.search(text):
        return spans
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


class Words:
    """The words of a text by place, found once the first context asks."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def places(self) -> tuple[list[int], list[int]]:
        found = [m.span() for m in re.compile(r"\S+").finditer(self.text)]
        return [a for a, _ in found], [b for _, b in found]

    def word(self, start: int, stop: int) -> str:
        """In lower case; of a very long one its length and a hash, which stand for the whole."""
        word = self.text[start:stop].lower()
        return word if len(word) <= LONG_WORD else f"{len(word)}#{xxhash.xxh3_128_hexdigest(word)}"

    def contexts(self, start: int, stop: int) -> list[str]:
        """The two words before, and the word before with the word after; a token's own word counts up to the token."""
        begins, ends = self.places
        i = bisect_left(begins, start) - 1
        left = [self.word(begins[j], min(ends[j], start)) for j in (i - 1, i) if j >= 0]
        i = bisect_right(ends, stop)
        right = [self.word(max(begins[i], stop), ends[i])] if i < len(ends) else []
        before = [f"{' '.join(left)} _"] if len(left) == 2 else []
        around = [f"{left[-1]} _ {right[0]}"] if left and right else []
        return before + around


def fits(token: str) -> tuple[int, int]:
    """The kinds a token may have, as bits; and those that stand when counted, where a card must pass its checksum."""
    if "@" in token:
        return 1, 1
    digits = OTHERS.sub("", token)
    kinds = by_number(len(digits), " " in token)
    return kinds, kinds & ~CARD_BIT if kinds & CARD_BIT and not luhn(digits) else kinds


@lru_cache(64)
def by_number(digits: int, blanks: bool) -> int:
    """The kinds that a token of so many digits may have, as bits; an ip has no blanks."""
    fit = [name for name, (low, high) in DIGITS.items() if low <= digits <= high and not (blanks and name == "ip")]
    return sum(1 << KINDS.index(name) for name in fit)


def _bare(text: str, begin: int, stop: int) -> tuple[int, int]:
    """A token's place without the punctuation around it; an opening bracket stays if one closes inside."""
    start = begin
    while text[stop - 1] in AROUND:
        stop -= 1
    while text[start] in AROUND:
        start += 1
    return start - (start > begin and text[start - 1] == "(" and ")" in text[start:stop]), stop


def _digits(text: str, start: int, stop: int) -> int:
    return len(OTHERS.sub("", text[start:stop]))


def _windows(text: str, start: int, stop: int) -> Iterator[tuple[int, int, bool]]:
    """The windows of two or more pieces of a run that can be of a kind, and whether each teaches.

    Of the windows that open the run the longest of each kind teaches, so the whole run if it is no longer than a kind
    allows. The others are only compared with what is known. Only the pieces of one window are held.
    """
    rest = ((m.start(), m.end(), _digits(text, *m.span())) for m in PIECE.finditer(text, start, stop))
    held: deque[tuple[int, int, int]] = deque()
    first, together = True, 0
    while True:
        while together <= MOST and (piece := next(rest, None)):
            held.append(piece)
            together += piece[2]
        if not held:
            return
        begin, _, total = held.popleft()
        together -= total
        offered = []
        if total:
            for _, end, digits in held:
                total += digits
                if total > MOST:
                    break
                kinds = by_number(total, True) if digits else 0
                if kinds:
                    offered.append((*_bare(text, begin, end), kinds))
        longest = {kind: b for _, b, kinds in offered for kind in range(len(KINDS)) if kinds >> kind & 1} if first else {}
        for a, b, _ in offered:
            yield a, b, b in longest.values()
        first = False


def candidates(text: str, spans: list[tuple[int, int, int]]) -> Iterator[dict]:
    """Seeds (with their kind) and other tokens with a digit or @ (kind null), with their contexts, as they are found.

    Other tokens end at white space, or are windows of digit groups that blanks join. Tokens without contexts teach
    nothing, but may be known from elsewhere; those that can be of no kind are left out.
    """
    words = Words(text)

    def row(a: int, b: int, kind: int | None, contexts: list[str]) -> Iterator[dict]:
        token = text[a:b].lower()
        kinds, counts = fits(token) if kind is None else (1 << kind, 1 << kind)
        if contexts or kinds:
            yield {"start": a, "stop": b, "token": token, "kind": kind, "kinds": kinds, "counts": counts, "contexts": contexts}

    for a, k, b in spans:
        yield from row(a, b, k, words.contexts(a, b))
    covered = sorted((a, b) for a, _, b in spans)
    taught = []  # runs that teach
    at = 0
    for begin, end in [*covered, (len(text), len(text))]:
        for m in RUN.finditer(text, at, begin) if at < begin else ():
            teaches_any = False
            for a, b, teaches in _windows(text, *m.span()) if " " in m[0] else ():
                before = a
                while before > at and text[before - 1] in AROUND:
                    before -= 1
                teaches_any |= teaches
                yield from row(a, b, None, words.contexts(before, b) if teaches else [])
            if teaches_any:
                taught.append(m.span())
        at = max(at, end)
    at, next_span, next_run = 0, 0, 0
    while mark := MARK.search(text, at):
        start = mark.start()
        while next_span < len(covered) and covered[next_span][1] <= start:
            next_span += 1
        if next_span < len(covered) and covered[next_span][0] <= start:
            at = covered[next_span][1]
            continue
        begin = start
        while begin > at and not text[begin - 1].isspace():
            begin -= 1
        stop = TOKEN_END.search(text, start).start()
        if next_span < len(covered):
            stop = min(stop, covered[next_span][0])
        a, b = _bare(text, begin, stop)
        while next_run < len(taught) and taught[next_run][1] <= a:
            next_run += 1
        piece = next_run < len(taught) and taught[next_run][0] < b and _digits(text, a, b) < LEAST  # of something longer
        yield from row(a, b, None, [] if piece else words.contexts(begin, b))
        at = stop


FIELDS = {"start": pa.int32(), "stop": pa.int32(), "token": pa.string(), "kind": pa.int32(), "kinds": pa.int32()}
FIELDS |= {"counts": pa.int32(), "contexts": pa.list_(pa.string())}


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, d1, d2, chunk, base, candidates): a text has a row of chunk 0, which holds its base spans, and more rows
    for each FOUND further candidates."""
    span = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())]))
    candidate = pa.list_(pa.struct(list(FIELDS.items())))
    for batch in slices(batches, ROWS):
        columns = [batch.column(c) for c in ("doc_id", "d1", "d2")]
        rows, many = [], 0

        def out() -> pa.RecordBatch:
            at, chunk, base, found = zip(*rows)
            keys = [c.take(pa.array(at)) for c in columns]
            return pa.RecordBatch.from_arrays(
                [*keys, pa.array(chunk, pa.int32()), pa.array(base, span), pa.array(found, candidate)],
                ["doc_id", "d1", "d2", "chunk", "base", "candidates"],
            )

        for i, text in enumerate(batch.column("text").to_pylist()):
            base = base_spans(text)
            rows.append((i, 0, [{"start": a, "kind": k, "stop": b} for a, k, b in base], []))
            for found in candidates(text, base):
                if many >= FOUND:
                    yield out()
                    rows, many = [(i, rows[-1][1] + 1, [], [])], 0
                rows[-1][3].append(found)
                many += 1
        if rows:
            yield out()


def _keyed(documents: DataFrame) -> DataFrame:
    texts = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return texts.withColumns(text_key(F.col("text")))


def _refuted(graph: DataFrame) -> DataFrame:
    """(token): candidates in contexts that hold hardly anything but tokens of no kind."""
    bad = graph.groupBy("context").agg(F.count_if(F.col("counts") == 0).alias("none"), F.count("kind").alias("seeds"))
    bad = bad.where((F.col("none") >= SUPPORT) & (F.col("none") >= TRUST * (F.col("none") + F.col("seeds")))).select("context")
    return graph.where("kind IS NULL AND counts > 0").join(bad, "context").select("token").distinct()


def _trusted(graph: DataFrame, believed: DataFrame) -> DataFrame:
    """(context, kind, votes): the kinds that a context vouches for, and how many of its tokens are believed to be so.

    Against it count its tokens that are not believed and can be of no kind that has support there. What is believed to
    be of another kind is as personal, and what may be of a supported kind is open: neither counts against it.
    """
    masks = believed.groupBy("token").agg(F.bit_or(F.expr("shiftleft(1, kind)")).alias("believed"))
    marked = graph.join(masks, "token", "left").withColumn("believed", F.coalesce("believed", F.lit(0)))
    votes = [F.count_if(F.expr(f"believed & {1 << k} > 0")).alias(f"votes{k}") for k in range(len(KINDS))]
    others = [F.count_if(F.expr(f"believed = 0 AND counts = {m}")).alias(f"others{m}") for m in range(1 << len(KINDS))]
    sums = marked.groupBy("context").agg(*votes, *others)
    supported = " + ".join(f"IF(votes{k} >= {SUPPORT}, {1 << k}, 0)" for k in range(len(KINDS)))
    sums = sums.withColumn("supported", F.expr(supported)).where("supported > 0")
    against = " + ".join(f"IF(supported & {m} = 0, others{m}, 0)" for m in range(1 << len(KINDS)))
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"votes{k}").alias("votes")) for k in range(len(KINDS)))))
    sums = sums.select("context", F.expr(against).alias("against"), each.alias("k")).select("context", "against", "k.*")
    enough = (F.col("votes") >= SUPPORT) & (F.col("votes") / (F.col("votes") + F.col("against")) >= TRUST)
    return sums.where(enough).select("context", "kind", "votes")


def learn_contexts(found: DataFrame) -> DataFrame:
    """(token, kind): tokens that trusted contexts show to be personal data. found: what _scan tells of each text.

    Equal tokens in equal contexts count once, so copies of a text teach nothing more. What is learned in a round is
    learned in all later ones, so the rounds end when one adds nothing.
    """
    seen = found.select(F.explode("candidates").alias("c")).select("c.*").withColumn("context", F.explode("contexts"))
    seen = seen.groupBy("context", "token").agg(*(F.max(c).alias(c) for c in ("kind", "kinds", "counts")))
    graph = written(seen)
    counts = F.when(F.col("refuted"), 0).otherwise(F.col("counts"))
    refuted = _refuted(graph).withColumn("refuted", F.lit(True))
    graph = written(graph.join(refuted, "token", "left").withColumn("counts", counts).drop("refuted"))
    seeds = graph.where("kind IS NOT NULL").select("token", "kind").distinct()
    believed = seeds
    many = 0
    while True:
        new = graph.where("kind IS NULL").select("context", "token", "kinds").join(_trusted(graph, believed), "context")
        new = new.where("kinds & shiftleft(1, kind) > 0").groupBy("token", "kind").agg(F.sum("votes").alias("votes"))
        learned = written(new)
        now = learned.count()
        if now == many:
            break
        many = now
        believed = seeds.unionByName(learned.select("token", "kind"))
    # Of several kinds the one with most votes; of equal ones a dotted quad is an ip, and others are not.
    shape = (F.col("kind") == KINDS.index("ip")) == F.col("token").rlike(r"\..*\..*\.")
    return learned.groupBy("token").agg(F.max_by("kind", F.struct("votes", shape, -F.col("kind"))).alias("kind"))


def _outermost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Without added spans that lie within other added spans, as a piece does in its run."""
    for batch in slices(batches, ROWS):
        kept = []
        for spans in batch.column("added").to_pylist():
            kept.append([])
            last = -1
            for s in sorted(spans, key=lambda s: (s["start"], -s["stop"])):
                if s["stop"] > last:
                    kept[-1].append(s)
                    last = s["stop"]
        columns = [batch.column("d1"), batch.column("d2"), pa.array(kept, batch.schema.field("added").type)]
        yield pa.RecordBatch.from_arrays(columns, ["d1", "d2", "added"])


def find_pii(documents: DataFrame) -> DataFrame:
    """(doc_id, d1, d2, base, spans), a row for each document; d1 and d2 stand for the text.

    base: array of (start, kind, stop) by the kinds' own patterns; spans: these and what contexts add, sorted. Starts and
    stops count code points, kind is a place in KINDS. Added spans never overlap base ones nor hold one another. Null is an empty text
    without spans. Equal rows give equal rows. Other columns are ignored.
    """
    id_type = documents.schema["doc_id"].dataType.simpleString()
    found = _keyed(documents).mapInArrow(
        _scan, f"doc_id {id_type}, d1 long, d2 long, chunk int, base array<{SPAN}>, candidates array<{CANDIDATE}>"
    )
    found = written(found)
    learned = learn_contexts(found)
    places = found.where("exists(candidates, c -> c.kind IS NULL)").select("d1", "d2", "chunk", "candidates")
    places = places.dropDuplicates(["d1", "d2", "chunk"])
    places = places.select("d1", "d2", F.explode(F.filter("candidates", lambda c: c["kind"].isNull())).alias("c"))
    places = places.select("d1", "d2", "c.start", "c.stop", "c.token")
    added = places.join(F.broadcast(learned) if small(learned) else learned, "token")
    added = added.groupBy("d1", "d2").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("added"))
    added = added.mapInArrow(_outermost, f"d1 long, d2 long, added array<{SPAN}>")
    joined = found.where("chunk = 0").select("doc_id", "d1", "d2", "base").join(added, ["d1", "d2"], "left")
    every = F.sort_array(F.concat("base", F.coalesce("added", F.array().cast(f"array<{SPAN}>"))))
    return joined.select("doc_id", "d1", "d2", "base", every.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:stop, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")


def mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span replaced by its kind; spans that overlap become one, named after the first."""
    out, done, last = [], 0, 0
    for start, kind, stop in spans:
        if start >= last:
            out += [text[done:start], f"<{KINDS[kind].upper()}>"]
            done = stop
        last = done = max(done, stop)
    return "".join([*out, text[done:]])


def masked(documents: DataFrame) -> DataFrame:
    """documents with personal data replaced in text; where nothing is found the text, null included, stays.

    The base patterns are applied where the text is; only what contexts add has to be joined to it.
    """
    found = find_pii(documents).where("size(spans) > size(base)")
    found = written(found.select("d1", "d2", "spans").dropDuplicates(["d1", "d2"]))
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row")  # keeps all names apart
    keyed = documents.select(row, *[key.alias(name) for name, key in text_key(F.coalesce("text", F.lit(""))).items()])
    joined = keyed.join(F.broadcast(found) if small(found, 100_000) else found, ["d1", "d2"], "left").select("row", "spans")
    names = documents.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, ROWS):
            texts = [
                t if t is None else mask(t, [(s["start"], s["kind"], s["stop"]) for s in a] if a else base_spans(t))
                for t, a in zip(batch.column("row").field("text").to_pylist(), batch.column("spans").to_pylist())
            ]
            columns = [pa.array(texts, pa.string()) if c == "text" else batch.column("row").field(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names)

    return joined.mapInArrow(run, documents.schema)
