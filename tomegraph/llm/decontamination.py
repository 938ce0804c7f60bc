"""Benchmark decontamination over a distributed positional inverted index.

The index is a Parquet table of segments. A segment covers whole documents of about SEGMENT_TOKENS
words and stores, for every term, the sorted positions of its occurrences. Query phrases are answered
within a segment all at once: phrases with a term that the segment lacks go by one vectorised look at
the terms' frequencies; for the others the postings of the rarest term, moved by its offset in the
phrase, are intersected with the postings of the other terms from rare to common. With a slop the
terms must follow each other in order within that many extra words (proximity matches).

Benchmark texts are queries against all rows; they come to the driver and go to the tasks one block
of bounded size at a time.

Defined cases: null and empty texts have no words and are not contaminated; an item without words
matches nothing; a null item_id counts as the empty string, a null doc_id stays null; repeated items
count once; equal doc_ids and repeated rows keep a row each, judged by its own text; empty tables give
no rows or no hits; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, NULL_ID, bounded_batches, identified, materialise, row_text, scratch_path, slices, table

SEGMENT_TOKENS = 500_000
#: Benchmark text sent to the tasks at once, in bytes.
QUERY_BLOCK_BYTES = 8 << 20
INDEX = "segment string, rows binary, doc_ids binary, starts binary, terms binary, offsets binary, positions binary"
SPANS = "array<struct<start: long, stop: long, item: string>>"
#: A-Z to lower case; every ASCII byte that is neither a digit nor a letter becomes a blank.
_FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def build_index(known: DataFrame, path: str | None = None) -> DataFrame:
    """Write the index of all identified() rows and return it."""
    spark = known.sparkSession
    path = path or scratch_path(spark, "positional-index")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[int] = []
        ids: list[int] = []
        counts: list[int] = []
        held: list[bytes] = []

        def segment() -> pa.RecordBatch:
            terms = dict.fromkeys(held)
            for i, w in enumerate(terms):
                terms[w] = i
            codes = np.fromiter(map(terms.__getitem__, held), np.uint32, len(held))
            positions = np.argsort(codes, kind="stable").astype("<u4")
            offsets = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms)))]).astype("<u4")
            starts = np.concatenate([[0], np.cumsum(counts)]).astype("<i8")
            parts = [np.array(rows, "<i8").tobytes(), np.array(ids, "<i8").tobytes(), starts.tobytes(), b" ".join(terms), offsets.tobytes(), positions.tobytes()]
            rows.clear(), ids.clear(), counts.clear(), held.clear()
            # only one attempt of a task reaches the table, so a random name stands for one segment
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), *(pa.array([x], pa.binary()) for x in parts)], ["segment", "rows", "doc_ids", "starts", "terms", "offsets", "positions"])

        for b in slices(it):
            for row, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                got = words(text)
                rows.append(row)
                ids.append(doc_id)
                counts.append(len(got))
                held += got
                if len(held) >= SEGMENT_TOKENS:
                    yield segment()
        if ids:
            yield segment()

    texts = row_text(known).withColumn("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)))
    with bounded_batches(spark):
        texts.mapInArrow(run, INDEX).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(INDEX).parquet(path)


class Queries:
    """Distinct phrases of a block of items: term ids, and the items of each phrase."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.terms: dict[bytes, int] = {}
        phrases: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            code = [self.terms.setdefault(w, len(self.terms)) for w in words(text)]
            for i in range(max(1, len(code) - window + 1) if code else 0):
                phrases.setdefault(tuple(code[i : i + window]), set()).add(item)
        self.items = [sorted(phrases[p]) for p in phrases]
        self.sizes = np.array([len(p) for p in phrases], np.int64)
        #: Term ids of each phrase; shorter ones are filled up with their first term.
        self.codes = np.array([[*p, *(p[0],) * (window - len(p))] for p in phrases], np.int64).reshape(len(phrases), window)


#: Places that are tried at once.
CHUNK = 1 << 20


def search(segment_terms: bytes, offsets: np.ndarray, positions: np.ndarray, starts: np.ndarray, q: Queries, slop: int) -> list[tuple[int, int, int]]:
    """(start, stop, phrase) of every occurrence inside one document of the segment."""
    if not len(q.codes) or not len(positions):
        return []
    place = {w: i for i, w in enumerate(segment_terms.split(b" "))}
    at = np.array([place.get(w, -1) for w in q.terms], np.int64)
    df = np.where(at >= 0, offsets[at + 1].astype(np.int64) - offsets[at], 0)
    own = df[q.codes]
    some = np.flatnonzero(own.min(1) > 0)
    if slop:
        post = lambda t: positions[offsets[at[t]] : offsets[at[t] + 1]].astype(np.int64)
        begin, end, phrase = [], [], []
        for k in some.tolist():
            n = int(q.sizes[k])
            b, e = _near(tuple(q.codes[k, :n].tolist()), own[k, :n], post, slop)
            begin.append(b), end.append(e), phrase.append(np.full(len(b), k))
        begin, end, phrase = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begin, end, phrase))
    else:
        begin, phrase = _exact(q, some, own, at, offsets, positions)
        end = begin + q.sizes[phrase]
    doc = np.searchsorted(starts, begin, "right") - 1
    ok = end <= starts[doc + 1]
    return list(zip(begin[ok].tolist(), end[ok].tolist(), phrase[ok].tolist(), strict=True))


def _exact(q: Queries, some: np.ndarray, df: np.ndarray, at: np.ndarray, offsets: np.ndarray, positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and phrases: offset-adjusted lists of the rarest terms, intersected with the others from rare to common.

    `term_at` is the postings turned round: whether a place is in a term's list is one look.
    """
    term_at = np.empty(len(positions), np.int64)
    term_at[positions] = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets.astype(np.int64)))
    order = np.argsort(df[some], axis=1, kind="stable")
    rarest = order[:, 0]
    n = df[some, rarest]
    begins, phrases = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    ends = np.cumsum(n)
    lo = 0
    while lo < len(some):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CHUNK, "right")))
        rows = np.repeat(np.arange(lo, hi), n[lo:hi])
        nth = np.arange(len(rows)) - np.repeat(ends[lo:hi] - n[lo:hi] - (ends[lo] - n[lo]), n[lo:hi])
        begin = positions[offsets[at[q.codes[some[rows], rarest[rows]]]] + nth].astype(np.int64) - rarest[rows]
        keep = (begin >= 0) & (begin + q.sizes[some[rows]] <= len(term_at))
        begin, rows = begin[keep], rows[keep]
        for i in range(1, order.shape[1]):
            if not len(begin):
                break
            spot = order[rows, i]
            inside = spot < q.sizes[some[rows]]
            keep = ~inside | (term_at[np.where(inside, begin + spot, 0)] == at[q.codes[some[rows], spot]])
            begin, rows = begin[keep], rows[keep]
        begins.append(begin)
        phrases.append(some[rows])
        lo = hi
    return np.concatenate(begins), np.concatenate(phrases)


def _near(phrase: tuple[int, ...], df: np.ndarray, post, slop: int) -> tuple[np.ndarray, np.ndarray]:
    """Spans in which the terms follow each other within len(phrase) + slop words, the shortest for each start."""
    rare = post(phrase[int(np.argmin(df))])
    begin = post(phrase[0])
    reach = len(phrase) + slop
    j = np.searchsorted(rare, begin)
    begin = begin[(j < len(rare)) & (rare[np.minimum(j, len(rare) - 1)] < begin + reach)]
    now = begin
    for t in phrase[1:]:
        p = post(t)
        j = np.searchsorted(p, now, "right")
        ok = j < len(p)
        begin, now = begin[ok], p[j[ok]]
    ok = now - begin < reach
    return begin[ok], now[ok] + 1


def _blocks(benchmark: DataFrame, window: int) -> Iterator[Queries]:
    """The items as queries, one block of QUERY_BLOCK_BYTES at a time."""
    block: list[tuple[str, str | None]] = []
    held = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    for r in rows.toLocalIterator():
        if held > QUERY_BLOCK_BYTES:
            yield Queries(block, window)
            block, held = [], 0
        block.append((r.item_id, r.text))
        held += len(r.text or "") + 64
    yield Queries(block, window)


_KIND = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("item", pa.string())]))
_PLACE = "segment string, ord long, row long, doc_id long, n_words long"


def _found(index: DataFrame, q: Queries, slop: int) -> DataFrame:
    """segment, ord, spans of the documents that a block of queries hits."""
    sent = index.sparkSession.sparkContext.broadcast(q)  # bounded by QUERY_BLOCK_BYTES

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = sent.value
        for b in slices(it, 1):
            name, starts, terms, offsets, positions = (b.column(c)[0].as_py() for c in range(5))
            starts = np.frombuffer(starts, "<i8")
            hits: dict[int, list[dict]] = {}
            for s, e, p in search(terms, np.frombuffer(offsets, "<u4"), np.frombuffer(positions, "<u4"), starts, q, slop):
                d = int(np.searchsorted(starts, s, "right")) - 1
                hits.setdefault(d, []).extend({"start": s - int(starts[d]), "stop": e - int(starts[d]), "item": x} for x in q.items[p])
            docs = sorted(hits)
            for lo in range(0, len(docs), 1000):
                part = docs[lo : lo + 1000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part), pa.string()), pa.array(part, pa.int64()), pa.array([hits[d] for d in part], _KIND)], ["segment", "ord", "spans"])

    found = materialise(index.select("segment", "starts", "terms", "offsets", "positions").mapInArrow(run, f"segment string, ord long, spans {SPANS}"), "benchmark-hits", batch_rows=8)
    sent.unpersist()
    return found


def _documents(index: DataFrame) -> DataFrame:
    """segment, ord (place in it), row, doc_id, n_words of all documents."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for name, *parts in zip(*(b.column(c).to_pylist() for c in range(4)), strict=True):
                rows, ids, starts = (np.frombuffer(x, "<i8") for x in parts)
                for lo in range(0, len(ids), 10_000):
                    own = slice(lo, lo + 10_000)
                    n = np.diff(starts[lo : lo + 10_001])
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(n), pa.string()), pa.array(np.arange(lo, lo + len(n))), pa.array(rows[own]), pa.array(ids[own]), pa.array(n)], ["segment", "ord", "row", "doc_id", "n_words"])

    return index.select("segment", "rows", "doc_ids", "starts").mapInArrow(run, _PLACE).withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def _hits(index: DataFrame, benchmark: DataFrame, window: int, slop: int) -> DataFrame:
    """segment, ord, spans of the documents with occurring windows, a row each."""
    hits = None
    for q in _blocks(benchmark, window):
        found = _found(index, q, slop)
        hits = found if hits is None else hits.unionByName(found)
    return materialise(hits.groupBy("segment", "ord").agg(F.flatten(F.collect_list("spans")).alias("spans")), "benchmark-spans")


def _with(index: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """_documents() with the columns of some (segment, ord, ...; of so many bytes), null where it has no row."""
    return _documents(index).join(F.broadcast(some) if size <= BROADCAST_BYTES // 4 else some, ["segment", "ord"], "left")


def row_matches(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """row, doc_id, n_words and spans (start, stop, item) of all occurring windows, per document of the index."""
    hits = _hits(index, benchmark, window, slop)
    every = _with(index, hits, hits.agg(F.sum(F.size("spans") * 64 + 64)).first()[0] or 0)
    return every.select("row", "doc_id", "n_words", F.coalesce("spans", F.array().cast(SPANS)).alias("spans"))


def matches(index: DataFrame, benchmark: DataFrame, window: int = 13, slop: int = 0) -> DataFrame:
    """Per document of the index: doc_id, n_words and spans (start, stop, item) of all occurring windows."""
    return row_matches(index, benchmark, window, slop).drop("row")


_JUDGED = "segment string, ord long, n_hit long, n_items long, items_sha256 string"


def _judged(b: pa.RecordBatch) -> pa.RecordBatch:
    n_hit, n_items, digest = [], [], []
    for found in b.column(2).to_pylist():
        hit, end = 0, 0
        for s, e in sorted({(x["start"], x["stop"]) for x in found}):
            hit += max(0, e - max(s, end))
            end = max(end, e)
        items = sorted({x["item"] for x in found})
        n_hit.append(hit)
        n_items.append(len(items))
        digest.append(hashlib.sha256(",".join(items).encode()).hexdigest())
    return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n_hit, pa.int64()), pa.array(n_items, pa.int64()), pa.array(digest, pa.string())], ["segment", "ord", "n_hit", "n_items", "items_sha256"])


def row_verdicts(index: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """Per document: row, doc_id, words, words hit, items and whether hit words are at least one in `share`.

    Only documents that are hit are judged in Python, and before they meet the others: a stage with
    two Python steps takes two workers a task, and those stay.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield _judged(b)

    judged = materialise(_hits(index, benchmark, window, 0).mapInArrow(run, _JUDGED), "judged")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit")
    every = _with(index, judged, 256 * judged.count()).select("row", "doc_id", "n_words", n_hit, F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(hashlib.sha256().hexdigest())).alias("items_sha256"))
    return materialise(every.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))), "verdicts")


def verdicts(index: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20) -> DataFrame:
    """row_verdicts() without the rows' numbers."""
    return row_verdicts(index, benchmark, window, share).drop("row")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(identified(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return verdicts(index, table(spark, sf_dir, "benchmark"))


ORACLE: dict[str, str] = {
    "op9_decontamination": """
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 11, 2))) AS i FROM b WHERE len(w) > 0)),
k AS (SELECT DISTINCT n FROM p),
o AS (SELECT r, i, k.n, array_to_string(w[i : i + k.n - 1], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) x JOIN k ON i + k.n - 1 <= len(w)),
h AS (SELECT o.r, o.i, o.n, p.item FROM o JOIN p ON o.s = p.s AND o.n = p.n),
c AS (SELECT r, count(DISTINCT j) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT r, i, n FROM h)) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""
}
