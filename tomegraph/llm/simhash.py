"""SimHash near-duplicates by Golay-code fuzzy hashing.

Two uses share the code in golay.py:

`linked` finds all pairs of 64-bit fingerprints within 2 bits, none missed. A fingerprint is cut into
segments of 22, 21 and 21 bits. By the pigeonhole principle two such fingerprints agree in one
segment, and one of the other two has at most one error there; so the bits of one segment with a
nearby codeword's index of another form the keys, and equal keys are the candidates, verified by the
number of differing bits. In crowded buckets a pair per two members would be too many: their
fingerprints meet at the words one bit away from them instead, which is exact as well, and of which
one is shared by 65 fingerprints at most, all within 2 bits of each other.

`near_groups` groups whole texts whose sets of word shingles have a Jaccard similarity of at least a
threshold. A plain 64-bit SimHash is too coarse for that: at 0.8 similarity 9.7 of its bits differ
on average. Here a document has many 23-bit segments; segment i is the weighted SimHash
of the shingles that come first in a random order of its own (weights fall with the square of the
rank's hash), its nearest codeword absorbs up to three flipped bits, and three segments' codewords
are a key. Sharing one of the BANDS keys makes a candidate; its true shingle sets decide. This is not
the 64-bit join of `linked`: of that only the decoding of segments and the pigeonholed keys are kept.
Keys that many texts share don't give their pairs: see `_crowd_links`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import golay
from .common import BROADCAST_BYTES, LAST_ID, components, id_text, identified, materialise, row_text, slices, table

_SEG = ((0, 22), (22, 21), (43, 21))
#: Members up to which a bucket's pairs are verified one by one; larger ones meet at midpoints.
PAIR_BUCKET = 32
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the space-joined shingles of the A-Z lower-cased words, repeats included."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(line, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    n = len(words) - size + 1
    hash_of = xxhash.xxh64_intdigest
    return np.fromiter((hash_of(line[a:b], 42) for a, b in zip(begins[:n].tolist(), ends[size - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(h: np.ndarray) -> int:
    """Bit set where it is set in over half of the hashes; zero of none."""
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = np.ascontiguousarray(h[i : i + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(h)).tolist()))


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) of every whole text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            fp = np.array([fingerprint(shingle_hashes(x, size)) for x in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return id_text(docs).mapInArrow(run, "doc_id long, fp long")


def pigeonhole_keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, key): for each ordered pair of segments the first one's bits with the codewords near the second."""
    u = fp.view(np.uint64)
    parts = [((u >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEG]
    near = [golay.keys(p) for p in parts]
    rows, keys = [], []
    for i in range(3):
        for j in range(3):
            if i != j:
                row, index = near[j]
                rows.append(row)
                keys.append((i * 3 + j) << 36 | parts[i][row] << 12 | index)
    return np.concatenate(rows), np.concatenate(keys)


def linked(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b as longs, that connect distinct fingerprints just as all pairs within 2 bits do."""

    def emit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = b.column(0).to_numpy().astype(np.int64)
            row, key = pigeonhole_keys(fp)
            yield pa.RecordBatch.from_arrays([pa.array(fp[row]), pa.array(key)], ["fp", "key"])

    keyed = materialise(fps.select("fp").mapInArrow(emit, "fp long, key long"), "golay-keys")
    size = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialise(keyed.join(size, "key"), "golay")
    few = shared.where(F.col("n") <= PAIR_BUCKET)
    a, b = few.select("key", F.col("fp").alias("a")), few.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, "key").where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    many = shared.where(F.col("n") > PAIR_BUCKET).select("fp").distinct()
    masks = F.array(F.lit(0).cast("long"), *(F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)))
    met = many.select("fp", F.explode(masks).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("mid"))
    low = met.groupBy("mid").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1")
    stars = met.join(low, "mid").where("fp <> a").select("a", F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_components(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of all documents; copies count once in the search.

    Null and empty texts have fingerprint zero and link like any other; equal doc_ids keep a row
    each; an empty table gives no rows; other columns are ignored.
    """
    rows = materialise(fingerprints(docs, size), "fingerprints")
    distinct = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    group = materialise(components(linked(distinct)), "groups")
    known = distinct.join(group, distinct.fp == group.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    ids = known.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = known.join(ids, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --- whole texts of a given shingle similarity ---------------------------------------------------

#: Keys of a text, and 23-bit segments in a key.
BANDS, ROWS = 12, 3
#: Shingles that vote in a segment: the first ones in the segment's own order.
VOTES = 3
#: Texts in a block that is held against another block at a time.
BLOCK = 256
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * _M1
        x = (x ^ (x >> np.uint64(29))) * _M2
        return x ^ (x >> np.uint64(32))


_SALTS = _mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def first_votes(h: np.ndarray) -> np.ndarray:
    """Per segment the VOTES smallest 32-bit ranks of the (distinct) shingles in the segment's order."""
    best = np.full((len(_SALTS), VOTES), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 4096):
        with np.errstate(over="ignore"):
            ranks = ((h[None, i : i + 4096] ^ (_SALTS[:, None] >> np.uint64(7))) * _SALTS[:, None] >> np.uint64(32)).astype(np.uint32)
        both = np.concatenate([best, ranks], 1)
        best = np.sort(np.partition(both, VOTES - 1, axis=1)[:, :VOTES], axis=1)
    return best


def band_keys(votes: np.ndarray) -> np.ndarray:
    """votes (texts, segments, VOTES) to keys (texts, BANDS): weighted SimHash bits, nearest codewords, joined by ROWS."""
    with np.errstate(over="ignore"):
        bits = _mix(votes.astype(np.uint64) * np.uint64(len(_SALTS)) + np.arange(len(_SALTS), dtype=np.uint64)[None, :, None])
    weight = 1.0 / (votes.astype(np.float64) + 1) ** 2
    weight /= weight[:, :, :1]
    word = np.zeros(votes.shape[:2], np.int64)
    for b in range(golay.WIDTH):
        sign = ((bits >> np.uint64(b)) & np.uint64(1)).astype(np.float64) * 2 - 1
        word |= ((sign * weight).sum(2) > 0).astype(np.int64) << b
    index = golay.nearest(word.ravel()).reshape(len(votes), BANDS, ROWS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.int64), (len(votes), BANDS)).copy()
    for r in range(ROWS):
        key = key << 12 | index[:, :, r]
    return key


def sketches(known: DataFrame, size: int = 5) -> DataFrame:
    """row, doc_id, copy (digest of the word sequence), keys (none for texts without words) of identified() rows."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in slices(it, 256):
            part = b.column(2).to_pylist()
            copy = [xxhash.xxh3_128_digest(b" ".join((x or "").encode("utf-8", "surrogatepass").translate(_UPPER).split())) for x in part]
            sets = [np.unique(shingle_hashes(x, size)) for x in part]
            keys = band_keys(np.stack([first_votes(h) for h in sets]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(copy, pa.binary()), pa.array([k if len(h) else [] for k, h in zip(keys, sets, strict=True)], pa.list_(pa.int64()))], ["row", "doc_id", "copy", "keys"])

    return row_text(known).mapInArrow(run, "row long, doc_id long, copy binary, keys array<long>")


def shingle_sets(known: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """id (a row number of identified() rows) and shingles (sorted distinct 32-bit hashes, little-endian) of the rows in ids.

    The ids go to the tasks as a filter while they are below BROADCAST_BYTES, else they are joined.
    """
    spark = known.sparkSession
    texts = row_text(known).select("row", "text")
    n = ids.count()
    if n * 8 < BROADCAST_BYTES // 4:
        wanted = np.sort(np.fromiter((r[0] for r in ids.toLocalIterator()), np.int64, n))
        sent = spark.sparkContext.broadcast(wanted)
    else:
        texts, sent = texts.join(ids.select(F.col("id").alias("row")), "row"), None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            if sent is not None:
                b = b.filter(pa.array(np.isin(b.column(0).to_numpy(zero_copy_only=False), sent.value)))
            got = [np.unique((shingle_hashes(x, size) >> np.uint64(16)).astype("<u4")).tobytes() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["id", "shingles"])

    return texts.mapInArrow(run, "id long, shingles binary")


def jaccard(a: bytes, b: bytes) -> float:
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both)


def block_links(a: list[bytes], b: list[bytes], threshold: float) -> np.ndarray:
    """(i, j) of all pairs between two lists of shingle sets that reach the threshold, by 0/1 matrix products."""
    xs, ys = [np.frombuffer(v, "<u4") for v in a], [np.frombuffer(v, "<u4") for v in b]
    universe = np.intersect1d(np.concatenate([*xs, np.zeros(0, "<u4")]), np.concatenate([*ys, np.zeros(0, "<u4")]))
    both = np.zeros((len(xs), len(ys)), np.float32)
    for lo in range(0, len(universe), 8192):
        part = universe[lo : lo + 8192]
        dense = []
        for sets in (xs, ys):
            m = np.zeros((len(sets), len(part)), np.float32)
            for i, v in enumerate(sets):
                own = v[np.searchsorted(v, part[0]) : np.searchsorted(v, part[-1], "right")]
                at = np.searchsorted(part, own)
                m[i, at[part[np.minimum(at, len(part) - 1)] == own]] = 1
            dense.append(m)
        both += dense[0] @ dense[1].T
    size = np.array([len(v) for v in xs])[:, None] + np.array([len(v) for v in ys])[None] - both
    return np.argwhere(both >= threshold * np.maximum(size, 1) - 1e-6)


def similar_links(known: DataFrame, shared: DataFrame, size: int, threshold: float) -> DataFrame:
    """Links (a, b) between ids of shared (key, id, n) that connect what the pairs under a common key connect.

    Keys of at most PAIR_BUCKET ids give their pairs, the ids of larger ones go to _crowd_links.
    """
    shared = materialise(shared, "keys")
    ids = materialise(shared.select("id").distinct(), "candidates")
    sets = materialise(shingle_sets(known, ids, size), "shingles")
    few = shared.where(F.col("n") <= PAIR_BUCKET)
    pairs = few.select("key", F.col("id").alias("a")).join(few.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()
    links = materialise(_verified(pairs, sets, threshold), "links")
    crowded = shared.where(F.col("n") > PAIR_BUCKET)
    return links if crowded.isEmpty() else links.unionByName(_crowd_links(crowded, links, sets, threshold))


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok = [jaccard(x, y) >= threshold - 1e-9 for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield b.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    full = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    return full.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long")


#: Rounds in which a crowd's open texts are held against a representative, and texts that shape one.
STAR_ROUNDS, PROFILE = 3, 64


def _crowd_links(crowded: DataFrame, links: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Links within the crowds that keys of many ids form, exact in what they connect.

    A round holds a crowd's open texts against one representative: the text nearest to the shingles
    that half of a sample of them have. What is not yet connected with the bulk of its crowd stays
    open. Texts still open at last are held against all texts of their crowd whose size allows the
    threshold, in blocks. A crowd of near copies is done by one comparison a text; only texts that
    share keys but are not similar cost more.
    """
    low = crowded.groupBy("key").agg(F.min("id").alias("a"))
    crowd = components(crowded.join(low, "key").select("a", F.col("id").alias("b"))).select(F.col("node").alias("id"), F.col("root").alias("crowd"))
    crowd = materialise(crowd.join(sets, "id").select("id", "crowd", (F.octet_length("shingles") / 4).alias("size")), "crowds")
    every, open_, n_open = links, crowd, crowd.count()
    new: list[DataFrame] = []
    for _ in range(STAR_ROUNDS):
        star = materialise(_verified(_stars(open_, sets), sets, threshold), "star-links")
        new.append(star)
        every = every.unionByName(star)
        open_ = materialise(_unconnected(crowd, every), "open-texts")
        left = open_.count()
        if not left or left > 0.9 * n_open:
            break
        n_open = left
    if not open_.isEmpty():
        new.append(_block_links(open_, crowd, sets, threshold))
    out = new[0]
    for n in new[1:]:
        out = out.unionByName(n)
    return out


def _unconnected(crowd: DataFrame, links: DataFrame) -> DataFrame:
    """Rows of crowd (id, crowd, …) that links don't connect with the largest connected part of their crowd."""
    part = components(links).select(F.col("node").alias("id"), F.col("root").alias("part"))
    placed = crowd.join(part, "id", "left").withColumn("part", F.coalesce("part", "id"))
    bulk = placed.groupBy("crowd", "part").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max_by("part", F.struct("n", "part")).alias("bulk"))
    return placed.join(bulk, "crowd").where("part <> bulk").select(*crowd.columns)


def _stars(open_: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) with a the representative of b's crowd."""
    import pandas as pd

    count = open_.groupBy("crowd").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    sample = open_.join(count, "crowd").where((F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PROFILE)) == 0) | (F.col("id") == F.col("first")))

    def profile(key, pdf):
        shingle, n = np.unique(np.concatenate([np.frombuffer(x, "<u4") for x in pdf["shingles"]]), return_counts=True)
        return pd.DataFrame({"crowd": [int(key[0])], "profile": [shingle[2 * n >= len(pdf)].tobytes()]})

    shape = materialise(sample.join(sets, "id").select("crowd", "shingles").groupBy("crowd").applyInPandas(profile, "crowd long, profile binary"), "profiles")
    if (shape.agg(F.sum(F.octet_length("profile") + 64)).first()[0] or 0) <= BROADCAST_BYTES // 4:
        shape = F.broadcast(shape)

    def near(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            score = [jaccard(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(score, pa.float64())], ["id", "crowd", "score"])

    score = open_.join(sets, "id").join(shape, "crowd").select("id", "crowd", "shingles", "profile").mapInArrow(near, "id long, crowd long, score double")
    centre = score.groupBy("crowd").agg(F.max_by("id", F.struct("score", -F.col("id"))).alias("a"))
    return open_.join(materialise(centre, "centres"), "crowd").where("a <> id").select("a", F.col("id").alias("b"))


def _spread(open_: DataFrame, crowd: DataFrame, threshold: float) -> DataFrame:
    """crowd, class, i, j, side, id: the blocks of open texts (side 0) that meet blocks of all texts (side 1) of fitting size."""
    step = F.floor(F.log(F.greatest("size", F.lit(1))) / float(-np.log(threshold))).cast("int")
    left = open_.select("crowd", "id", step.alias("class"))
    right = crowd.select("crowd", "id", F.explode(F.array(step - 1, step, step + 1)).alias("class"))
    n_left = left.groupBy("crowd", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_i"))
    n_right = right.groupBy("crowd", "class").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_j"))
    size = n_left.join(n_right, ["crowd", "class"])
    place = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = left.join(size, ["crowd", "class"]).select("crowd", "class", place("n_i").alias("i"), each("n_j").alias("j"), F.lit(0).alias("side"), "id")
    b = right.join(size, ["crowd", "class"]).select("crowd", "class", each("n_i").alias("i"), place("n_j").alias("j"), F.lit(1).alias("side"), "id")
    return a.unionByName(b)


def _block_links(open_: DataFrame, crowd: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    import pandas as pd

    def block(pdf):
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        got = block_links(left["shingles"].tolist(), right["shingles"].tolist(), threshold)
        a, b = left["id"].to_numpy()[got[:, 0]], right["id"].to_numpy()[got[:, 1]]
        return pd.DataFrame(_forest(a, b), columns=["a", "b"])

    return _spread(open_, crowd, threshold).join(sets, "id").groupBy("crowd", "class", "i", "j").applyInPandas(block, "a long, b long")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Links that join the same nodes as the given ones, one less than nodes at most."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    kept = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            kept.append((min(x, y), max(x, y)))
    return np.array(kept, np.int64).reshape(-1, 2)


def near_rows(known: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """row, doc_id, keep_row, group_id of identified() rows: links are similarities of at least the threshold.

    The row that stays has the smallest doc_id of its group, among equal ones the first place; rows
    without a doc_id come last. Texts of the same words count as copies and meet first, so each
    distinct text is searched once; texts without words are copies of each other.
    """
    rows = materialise(sketches(known, size), "sketches")
    texts = materialise(rows.groupBy("copy").agg(F.min("row").alias("id"), F.first("keys").alias("keys")), "texts")
    keyed = texts.select("id", F.explode("keys").alias("key"))
    held = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    links = materialise(similar_links(known, keyed.join(held, "key"), size, threshold), "links")
    group = components(links)
    by_copy = texts.join(group, texts.id == group.node, "left").select("copy", F.coalesce("root", "id").alias("part"))
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST_ID)).alias("ord"), "row", "doc_id"))
    by_copy = materialise(by_copy.join(rows.groupBy("copy").agg(first.alias("first")), "copy"), "near-copies")
    keeper = by_copy.groupBy("part").agg(F.min("first").alias("keep"))
    kept = by_copy.join(keeper, "part").select("copy", F.col("keep.row").alias("keep_row"), F.col("keep.doc_id").alias("group_id"))
    return rows.join(kept, "copy").select("row", "doc_id", "keep_row", "group_id")


def near_groups(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of its group) of every row, as near_rows tells them.

    Equal and null doc_ids are rows of their own; a group of rows without ids has none; an empty
    table gives no rows; other columns are ignored.
    """
    return near_rows(identified(docs.select("doc_id", "text")), size, threshold).select("doc_id", "group_id")


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
