"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated.

Words, runs of marks and the shape of words (upper case, digits) are hashed to SLOTS slots. Every
slot has a fixed sparse random index vector; the vector of a slot is the sum of the index vectors
of its neighbours over the whole corpus, damped and normalised. A document is the mean of its
words' index vectors and of their corpus vectors, the spread of the latter, and its size. A network with one hidden layer
learns from at most TRAIN_ROWS labelled documents (those with the smallest hash) that are not held
out; the temperature is fitted on a tenth of them kept aside.

Labels are read for training only; lang, source and doc_id are never inputs of a score.

Defined cases: null and empty texts get a score from the zero vector; with no usable label, or one
only, every score is the labels' mean (0.5 without any); equal doc_ids keep a row each, and the one
whose text has the smallest hash is learnt from; repeated labels of a document count by their mean;
rows without a doc_id are scored, but have no label; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, id_text, identified, materialise, slices, table, without

SLOTS, WIDTH, WINDOW = 1 << 13, 48, 2
TRAIN_ROWS, HIDDEN, EPOCHS = 20_000, 24, 60
CUT = 0.7
#: Words of a text handled at a time.
CHUNK = 50_000
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|[^A-Za-z0-9\x80-\xff\s]+")


def index_vectors() -> np.ndarray:
    """SLOTS x WIDTH, four entries of +-1 in each row; the same everywhere."""
    r = np.random.default_rng(7)
    out = np.zeros((SLOTS, WIDTH), np.float32)
    at = np.argsort(r.random((SLOTS, WIDTH)), axis=1)[:, :4]
    np.put_along_axis(out, at, r.choice([-1.0, 1.0], (SLOTS, 4)).astype(np.float32), 1)
    return out


class Slots(dict):
    """Token to slot, remembered up to a bound."""

    def __missing__(self, token: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        word = token.lower() if not token.isupper() or len(token) < 2 else b"\x01" + token.lower()[:1]
        if token.isdigit():
            word = b"\x02%d" % len(token)
        elif not token[:1].isalpha() and token[0] < 128:
            word = b"\x03" + bytes(sorted(set(token))) + (b"+" if len(token) > 1 else b"")
        self[token] = slot = zlib.crc32(word) % SLOTS
        return slot


def codes(text: str | None, slots: Slots) -> np.ndarray:
    """Slots of a text's words, one by one; `_words` gives the same for many texts at once."""
    got = _TOKEN.findall((text or "").encode("utf-8", "replace"))
    return np.fromiter(map(slots.__getitem__, got), np.int32, len(got))


#: What a byte is part of, as in _TOKEN.
_BLANK, _LETTERS, _DIGITS, _MARKS = range(4)
_KIND = bytes(_BLANK if b in b" \t\n\r\f\v" else _DIGITS if b in b"0123456789" else _LETTERS if b >= 128 or bytes([b]).isalpha() else _MARKS for b in range(256))
_BYTES = [bytes([b]) for b in range(256)]
_UPPER, _LOWER = np.array([b.isupper() for b in _BYTES]), np.array([b.islower() for b in _BYTES])
#: Bytes of a word whose slot is worked out beside those of other words.
LONG = 24
#: A CRC is the exclusive or of what each byte adds at its distance from the end, and that of as many zeros.
_ZEROS = np.array([zlib.crc32(bytes(n)) for n in range(LONG + 1)], np.uint32)
_ADDS = np.array([[zlib.crc32(b.lower() + bytes(j)) ^ zlib.crc32(bytes(j + 1)) for b in _BYTES] for j in range(LONG)], np.uint32)
_ONE = Slots()
#: Slots of words in capitals by first byte, of numbers by length, of single marks.
_CAPITALS = np.array([zlib.crc32(b"\x01" + b.lower()) % SLOTS for b in _BYTES], np.int32)
_NUMBERS = np.array([_ONE[b"0" * max(n, 1)] for n in range(LONG + 1)], np.int32)
_SINGLE = np.array([_ONE[b] for b in _BYTES], np.int32)


def _token_slots(raw: bytes, begin: np.ndarray, end: np.ndarray, kind: np.ndarray, slots: Slots) -> np.ndarray:
    """Slots of the tokens raw[begin:end], as `slots` has them."""
    data, size = np.frombuffer(raw, np.uint8), end - begin
    first = data.take(begin)
    out = _SINGLE.take(first)
    at = np.flatnonzero(kind == _DIGITS)
    out[at] = _NUMBERS.take(np.minimum(size[at], LONG))
    alone = (size > LONG) | ((kind == _MARKS) & (size > 1))
    at = np.flatnonzero((kind == _LETTERS) & ~alone)
    at = at[np.argsort((LONG - size[at]).astype(np.uint8), kind="stable")]  # longest first
    n = size[at]
    reach = len(n) - np.cumsum(np.bincount(n, minlength=LONG + 1))  # words of more than j bytes
    place, crc = end[at], _ZEROS.take(n)
    for j in range(n[0] if len(n) else 0):
        m = reach[j]
        place[:m] -= 1
        crc[:m] ^= _ADDS[j].take(data.take(place[:m]))
    out[at] = crc % SLOTS
    at = at[~_LOWER.take(first[at]) & (n > 1)]
    at = at[~_LOWER.take(data.take(begin[at] + 1))]
    upper, lower, n = np.zeros(len(at), bool), np.zeros(len(at), bool), size[at]
    reach = len(n) - np.cumsum(np.bincount(n, minlength=LONG + 1))
    for j in range(n[0] if len(n) else 0):
        byte = data.take(begin[at[: reach[j]]] + j)
        upper[: reach[j]] |= _UPPER.take(byte)
        lower[: reach[j]] |= _LOWER.take(byte)
    at = at[upper & ~lower]
    out[at] = _CAPITALS.take(first[at])
    at = np.flatnonzero(alone)
    out[at] = [slots[raw[a:z]] for a, z in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
    return out


def _words(raw: bytes, bounds: np.ndarray, slots: Slots) -> tuple[np.ndarray, np.ndarray]:
    """Slots of the words of the texts that `bounds` cuts raw into, and the texts' bounds among them."""
    kind = np.frombuffer(raw.translate(_KIND), np.uint8)
    change = np.ones(len(raw), bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change[bounds[bounds < len(raw)]] = True
    begin = np.flatnonzero(change)
    end, kind = np.append(begin, len(raw))[1:], kind.take(begin)
    kept = np.flatnonzero(kind != _BLANK)
    begin, end, kind = begin.take(kept), end.take(kept), kind.take(kept)
    word = np.empty(len(begin), np.int32)
    for lo in range(0, len(begin), CHUNK):
        part = slice(lo, lo + CHUNK)
        word[part] = _token_slots(raw, begin[part], end[part], kind[part], slots)
    return word, np.searchsorted(begin, bounds)


def _batches(column: pa.Array | list[str | None], slots: Slots) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Slices of documents: first, last, joined codes and the documents' bounds."""
    if not isinstance(column, pa.Array):
        column = pa.array([(t or "").encode("utf-8", "replace") for t in column], pa.binary())
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    at = 0
    while at < len(column):
        # the few rows keep row and slot within 32 bits
        to = max(at + 1, min(at + 1000, int(np.searchsorted(ends, ends[at] + 6 * CHUNK, "right")) - 1))
        raw = data[ends[at] : ends[to]].to_pybytes() if data else b""
        yield at, to, *_words(raw, ends[at : to + 1] - ends[at], slots)
        at = to


def _places(index: np.ndarray) -> np.ndarray:
    """Columns of each index vector's four entries, one row an entry; those of -1 are counted WIDTH further on."""
    slot, column = np.nonzero(index[:SLOTS])
    return np.ascontiguousarray((column + WIDTH * (index[slot, column] < 0)).reshape(SLOTS, -1).T)


def _context(word: np.ndarray, bounds: np.ndarray, index: np.ndarray, total: np.ndarray, places: np.ndarray | None = None) -> None:
    """Add each word's neighbours' index vectors to its slot's row; neighbours stay within a document.

    Entries of 1 and of -1 are counted by slot and column, four a neighbour.
    """
    places = _places(index) if places is None else places
    doc = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for lo in range(0, len(word), CHUNK):
        cells = []
        for d in range(1, WINDOW + 1):
            near = word[lo + d : lo + d + CHUNK]
            own = word[lo : lo + len(near)]
            both = np.flatnonzero(doc[lo : lo + len(near)] == doc[lo + d : lo + d + CHUNK])
            own, near = own.take(both).astype(np.int64), near.take(both).astype(np.int64)
            for a, b in ((own, near), (near, own)):
                row = a * (2 * WIDTH)
                cells += [p.take(b) + row for p in places]
        count = np.bincount(np.concatenate(cells), minlength=SLOTS * 2 * WIDTH).reshape(SLOTS, 2 * WIDTH)
        total += count[:, :WIDTH]
        total -= count[:, WIDTH:]


def word_vectors(docs: DataFrame) -> np.ndarray:
    """Slots' vectors from all documents: tasks sum their own rows, Spark adds the sums slot by slot.

    The model has SLOTS x WIDTH numbers whatever the corpus, so it may come to the driver.
    """
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, slots = index_vectors(), Slots()
        places, total = _places(index), np.zeros((SLOTS, WIDTH))
        for b in slices(it):
            for _, _, word, bounds in _batches(b.column(0), slots):
                _context(word, bounds, index, total, places)
        used = np.flatnonzero(total.any(axis=1))
        for lo in range(0, len(used), 1024):
            part = used[lo : lo + 1024]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(list(total[part]), pa.list_(pa.float64()))], ["slot", "v"])

    parts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "slot long, v array<double>")
    # sums of whole numbers: exact in any order
    summed = parts.groupBy("slot").agg(F.array(*(F.sum(F.col("v")[i]) for i in range(WIDTH))).alias("v"))
    out = np.zeros((SLOTS, WIDTH))
    for r in materialise(summed, "word-vectors").toLocalIterator():
        out[r.slot] = r.v
    out = np.sign(out) * np.log1p(np.abs(out))
    return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def pooled(column: pa.Array | list[str | None], vectors: np.ndarray, index: np.ndarray, slots: Slots) -> np.ndarray:
    """One row per text: mean index vector, mean corpus vector, spread of the latter, log size."""
    out = np.zeros((len(column), 3 * WIDTH + 1))
    wide = vectors.astype(np.float64)
    both = np.hstack([index, wide, wide**2])
    room = np.empty_like(both)
    for lo, hi, word, bounds in _batches(column, slots):
        n = np.diff(bounds)
        cell, times = np.unique(np.repeat(np.arange(hi - lo, dtype=np.int32), n) * SLOTS + word, return_counts=True)
        ends, slot, times = np.searchsorted(cell, np.arange(hi - lo + 1) * SLOTS).tolist(), cell % SLOTS, times.astype(float)
        for row in np.flatnonzero(n).tolist():
            a, z = ends[row], ends[row + 1]
            # not BLAS, which takes threads of its own for a text
            np.einsum("i,ij->j", times[a:z], both.take(slot[a:z], axis=0, out=room[: z - a], mode="clip"), out=out[lo + row, : 3 * WIDTH])
        out[lo:hi, : 3 * WIDTH] /= np.maximum(n, 1)[:, None]
        out[lo:hi, -1] = np.log1p(n)
    mean, spread = out[:, WIDTH : 2 * WIDTH], out[:, 2 * WIDTH : 3 * WIDTH]
    spread[:] = np.sqrt(np.maximum(spread - mean**2, 0))
    return out


class Network:
    """Inputs, one tanh layer, one logit; Adam on the log loss; a temperature on held-back rows."""

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
        self.plain = float(y.mean()) if len(y) else 0.5
        self.ready = len(y) >= 20 and 0 < self.plain < 1
        if not self.ready:
            return self
        r = np.random.default_rng(seed)
        self.centre, self.scale = x.mean(0), x.std(0) + 1e-6
        x = (x - self.centre) / self.scale
        order = r.permutation(len(x))
        kept, rows = order[: len(x) // 10], order[len(x) // 10 :]
        p = {"a": r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": r.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), "d": np.zeros(1)}
        m = {k: np.zeros_like(v) for k, v in p.items()}
        s = {k: np.zeros_like(v) for k, v in p.items()}
        weight = np.where(y == 1, 0.5 / max(self.plain, 1e-6), 0.5 / max(1 - self.plain, 1e-6))
        step = 0
        for _ in range(EPOCHS):
            r.shuffle(rows)
            for i in range(0, len(rows), 256):
                k = rows[i : i + 256]
                step += 1
                hidden = np.tanh(x[k] @ p["a"] + p["b"])
                out = (1 / (1 + np.exp(-np.clip(hidden @ p["c"] + p["d"], -30, 30))) - y[k]) * weight[k] / len(k)
                back = np.outer(out, p["c"]) * (1 - hidden**2)
                g = {"a": x[k].T @ back + 1e-4 * p["a"], "b": back.sum(0), "c": hidden.T @ out + 1e-4 * p["c"], "d": np.array([out.sum()])}
                for n in p:
                    m[n] = 0.9 * m[n] + 0.1 * g[n]
                    s[n] = 0.999 * s[n] + 0.001 * g[n] ** 2
                    p[n] = p[n] - 0.01 * (m[n] / (1 - 0.9**step)) / (np.sqrt(s[n] / (1 - 0.999**step)) + 1e-8)
        self.p = p
        logit = self._logit(x[kept])
        # the classes were weighted alike; the shift gives the odds of the labels back
        self.shift = float(np.log(self.plain / (1 - self.plain)))
        loss = lambda t: -np.mean(np.where(y[kept] == 1, -np.logaddexp(0, -(logit / t + self.shift)), -np.logaddexp(0, logit / t + self.shift))) if len(kept) else t
        self.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
        return self

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["a"] + self.p["b"]) @ self.p["c"] + self.p["d"]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if not self.ready:
            return np.full(len(x), self.plain)
        logit = self._logit((x - self.centre) / self.scale)
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature + self.shift, -50, 50)))


def held_out():
    """Rows whose labels are not learnt from."""
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


class Classifier:
    """Vectors and network sent to the tasks; scores whole texts."""

    def __init__(self, spark: SparkSession, vectors: np.ndarray):
        self.spark = spark
        self.vectors = spark.sparkContext.broadcast((vectors, index_vectors()))
        self.network = None

    @classmethod
    def fit(cls, docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Classifier:
        own = cls(docs.sparkSession, word_vectors(docs))
        vectors = own.vectors

        def pool(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = Slots()
            for b in slices(it):
                x = pooled(b.column(1), *vectors.value, slots)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x.astype("<f4")], pa.binary())], ["doc_id", "x"])

        known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").where(~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.avg("quality").alias("y"))
        chosen = materialise(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows), "labels")
        rows = id_text(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most train_rows labels
        with bounded_batches(own.spark):
            sample = rows.select("doc_id", "text").mapInArrow(pool, "doc_id long, x binary").join(F.broadcast(chosen), "doc_id").toPandas().sort_values("doc_id")
        x = np.frombuffer(b"".join(sample["x"]), "<f4").reshape(len(sample), 3 * WIDTH + 1).astype(float)
        own.network = own.spark.sparkContext.broadcast(Network().fit(x, (sample["y"].to_numpy(float) >= 0.5).astype(float)))
        return own

    def scores(self, docs: DataFrame, cut: float = CUT) -> DataFrame:
        """doc_id, held_out, score, predicted of every document."""
        vectors, network = self.vectors, self.network

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = Slots()
            for b in slices(it):
                score = network.value.predict(pooled(b.column(1), *vectors.value, slots))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score), pa.array((score >= cut).astype(np.int32))], ["doc_id", "score", "predicted"])

        out = materialise(id_text(docs).mapInArrow(run, "doc_id long, score double, predicted int"), "scores")
        return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", "predicted")

    def accepted(self, docs: DataFrame, cut: float = CUT) -> DataFrame:
        """The rows of docs, all columns, whose score reaches the cut; texts go to Python but don't come back."""
        vectors, network, known = self.vectors, self.network, identified(docs)

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots = Slots()
            for b in slices(it):
                low = ~(network.value.predict(pooled(b.column(1), *vectors.value, slots)) >= cut)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(low))], ["row"])

        texts = known.select("row", F.col("doc.text").cast("string").alias("text"))
        return without(known, materialise(texts.mapInArrow(run, "row long"), "rejected"))


def scores(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    return Classifier.fit(docs, labels, train_rows).scores(docs, cut)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLE: dict[str, str] = {}
