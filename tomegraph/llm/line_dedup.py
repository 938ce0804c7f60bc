"""Line de-duplication by a deletion-neighbourhood join on words.

Lines are taken in the order of (doc_id, row, line number). A line is dropped when it equals an earlier
line, or is one word edit (insert, delete, replace) away from an earlier line that stays; `keep` names
that line. So in a chain of lines one edit apart each, a line whose only neighbour goes stays itself,
and every dropped line has one in the corpus that is equal or one edit away. Lines are compared by
their A-Z lower-cased words. Lines of fewer than `min_words` words are left alone (1: only blank ones),
those of fewer than `near_words` need an equal line: one edit in five words is a similarity of 0.8.
A document that loses lines is dropped as a whole when nothing but blanks is left of it. Characters
of scripts without blanks count as words.

Distinct lines are represented by their earliest occurrence. One edit leaves the first or the last
half of the shorter line untouched, so only lines that share such a half with another line enter the
join. They emit hashes of the variants with one word deleted: a replacement at word j makes equal
variants of equal (j, length), an insertion makes the shorter line equal to a variant of the longer
one. A bucket therefore holds lines one edit apart and is held against its earliest line only, never
pair by pair: words decide whether a line belongs to it. Which lines stay is then settled in rounds,
each two aggregates: a line goes when a bucket has an earlier line that stays, and stays when no
bucket has an earlier line that is still open.

Defined cases: null text is empty text; blank lines and line ends stay as they are; rows of equal doc_id
are rows of their own, ties go by their place in the input; rows without a doc_id come last; of equal
rows the first keeps its lines; an empty table gives no rows; other columns stay, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LAST_ID, bounded_batches, identified, materialise, row_text, slices, table

MIN_WORDS, NEAR_WORDS = 1, 5
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: What a line has to emit: variants of the second and first half for replacements, itself, variants of both halves for insertions.
SUB_2, SUB_1, WHOLE, DEL_2, DEL_1 = 1, 2, 4, 8, 16


#: Thai, Lao, Burmese, Khmer, kana and Han are written without blanks: each character is a word.
_UNSPACED = r"\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
_EACH = re.compile(f"[{_UNSPACED}\U00020000-\U0003ffff]")


def line_words(text: str | None) -> list[list[bytes]]:
    if text and not text.isascii() and _EACH.search(text):
        text = _EACH.sub(r" \g<0> ", text)
    return [x.split() for x in (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split(b"\n")]


def _half_keys(words: list[bytes]) -> list[int]:
    """Signed 64-bit hashes of (class, half): first and last half for lines of this length, and of one word less."""
    import xxhash

    n = len(words)
    out = []
    for m in (n, n - 1):
        h = m // 2
        for side, part in ((0, words[:h]), (1, words[n - (m - h) :])):
            out.append(xxhash.xxh64_intdigest(b" ".join(part), m * 2 + side) - (1 << 63))
    return out


def variants(words: list[bytes], mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed keys and their kinds (0 replacement, 1 whole, 2 deletion) that `mask` asks for.

    The hash of a word sequence is a polynomial modulo 2**64 in the words' own hashes, so each
    variant's is had from the prefix sums.
    """
    import xxhash

    n = len(words)
    w = np.array([xxhash.xxh64_intdigest(x) for x in words], np.uint64)
    power = np.ones(n + 1, np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = np.cumprod(np.full(n, _BASE, np.uint64))
        prefix = np.concatenate([[np.uint64(0)], np.cumsum(w * power[:n])])
        whole = prefix[n]
        less = prefix[:n] + (whole - prefix[1:]) * np.uint64(_INVERSE)
        spot = np.arange(n, dtype=np.uint64)
        sub = (less ^ (spot * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(n))) * np.uint64(0xFF51AFD7ED558CCD) + np.uint64(1)
        keys, kinds = [], []
        half, low = n // 2, (n - 1) // 2  # classes n and n - 1
        for bit, part, kind in ((SUB_2, sub[half:], 0), (SUB_1, sub[:half], 0), (WHOLE, whole[None] + np.uint64(n), 1), (DEL_2, less[low:] + np.uint64(n - 1), 2), (DEL_1, less[:low] + np.uint64(n - 1), 2)):
            if mask & bit:
                keys.append(part)
                kinds.append(np.full(len(part), kind, np.int8))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int8)
    return np.concatenate(keys).view(np.int64), np.concatenate(kinds)


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Word edit distance of at most one."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def _hid(h: bytes) -> int:
    """What xxhash64(h) gives in SQL."""
    import xxhash

    code = xxhash.xxh64_intdigest(h, 42)
    return code - (1 << 64) if code >> 63 else code


def _digest(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words))


def _lines(known: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """e (ord, row, line_no: the line's place), h, n, halves of every line."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            cols: list[list] = [[], [], [], [], [], []]
            for row, ord_, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                for k, words in enumerate(line_words(text)):
                    if words and len(words) >= min_words:
                        for c, x in zip(cols, (ord_, row, k, _digest(words), len(words), _half_keys(words) if len(words) >= near_words else []), strict=True):
                            c.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["ord", "row", "line_no", "h", "n", "halves"])

    texts = row_text(known).select("row", F.coalesce("doc_id", F.lit(LAST_ID)).alias("ord"), "text")
    return texts.mapInArrow(run, "ord long, row long, line_no int, h binary, n int, halves array<long>").select(F.struct("ord", "row", "line_no").alias("e"), "h", "n", "halves")


def _candidates(first: DataFrame, near_words: int) -> DataFrame:
    """hid (hash of h) and mask of distinct lines that share a half with another line of fitting length.

    Two lines of one hid only add variants that nothing meets.
    """
    near = first.where(F.col("n") >= near_words)
    keyed = near.select(F.xxhash64("h").alias("hid"), F.posexplode("halves").alias("which", "key")).withColumn("low", F.col("which") >= 2)
    size = keyed.groupBy("key").agg(F.count(F.when(~F.col("low"), 1)).alias("same"), F.count(F.when(F.col("low"), 1)).alias("longer")).where("same > 1 OR (same > 0 AND longer > 0)")
    own = keyed.join(size, "key")
    last = F.col("which") % 2 == 1
    bits = (
        F.when(~F.col("low") & (F.col("same") > 1), F.when(last, SUB_1).otherwise(SUB_2)).otherwise(0)
        + F.when(~F.col("low") & (F.col("longer") > 0), WHOLE).otherwise(0)
        + F.when(F.col("low") & (F.col("same") > 0), F.when(last, DEL_1).otherwise(DEL_2)).otherwise(0)
    )
    return own.groupBy("hid").agg(F.bit_or(bits.cast("int")).alias("mask")).where("mask > 0")


def _variant_rows(known: DataFrame, candidates: DataFrame, near_words: int) -> DataFrame:
    """h, line, keys, kinds of each candidate line (a line may come several times).

    The candidates' hashes and masks (9 bytes each) go to the tasks while they are below
    BROADCAST_BYTES; beyond that the lines are joined with them.
    """
    spark = known.sparkSession
    texts = row_text(known).select("text")
    fields = "h binary, line binary, keys array<long>, kinds array<tinyint>"
    kinds = (pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int8()))
    names = ["h", "line", "keys", "kinds"]
    if candidates.count() * 9 * 8 < BROADCAST_BYTES:
        small = candidates.toPandas()
        codes = small["hid"].to_numpy(np.int64)
        order = np.argsort(codes)
        sent = spark.sparkContext.broadcast((codes[order], small["mask"].to_numpy(np.int64)[order] if len(small) else np.zeros(0, np.int64)))

        def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            codes, masks = sent.value
            seen: set[bytes] = set()  # at most the candidates
            for b in slices(it):
                cols: list[list] = [[], [], [], []]
                for text in b.column(0).to_pylist():
                    for words in line_words(text):
                        if len(words) < near_words:
                            continue
                        h = _digest(words)
                        code = _hid(h)
                        at = int(np.searchsorted(codes, code))
                        if at < len(codes) and codes[at] == code and h not in seen:
                            seen.add(h)
                            for c, x in zip(cols, (h, b" ".join(words), *variants(words, int(masks[at]))), strict=True):
                                c.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

        return texts.mapInArrow(run, fields)

    def all_lines(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(it):
            got = [w for text in b.column(0).to_pylist() for w in line_words(text) if len(w) >= near_words]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(w) for w in got], pa.binary()), pa.array([b" ".join(w) for w in got], pa.binary()), pa.array([_hid(_digest(w)) for w in got], pa.int64())], ["h", "line", "hid"])

    def expand(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            lines = b.column(1).to_pylist()
            got = [variants(x.split(), m) for x, m in zip(lines, b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lines, pa.binary()), pa.array([k for k, _ in got], kinds[2]), pa.array([k for _, k in got], kinds[3])], names)

    joined = texts.mapInArrow(all_lines, "h binary, line binary, hid long").join(candidates, "hid")
    return joined.select("h", "line", "mask").mapInArrow(expand, fields)


def _buckets(known: DataFrame, first: DataFrame, near_words: int) -> DataFrame:
    """bucket, side, h, e: lines one edit apart. Side 0: any two members; sides 1 and 2: a line with those one word longer."""
    candidates = materialise(_candidates(first, near_words), "line-candidates")
    rows = materialise(_variant_rows(known, candidates, near_words).dropDuplicates(["h"]), "line-variants")
    place = rows.join(first.select("h", "e"), "h")
    keyed = place.select("h", "e", F.explode(F.arrays_zip("keys", "kinds")).alias("k")).select("h", "e", F.col("k.keys").alias("key"), F.col("k.kinds").alias("side")).distinct()
    of = lambda side: F.min(F.when(F.col("side") == side, F.struct("e", "h")))
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    heads = keyed.groupBy("key").agg(of(0).alias("m0"), of(1).alias("m1"), count(0).alias("n0"), count(1).alias("n1"), count(2).alias("n2")).where("n0 > 1 OR (n1 > 0 AND n2 > 0)")
    met = keyed.join(heads.select("key", F.when(F.col("n0") > 1, F.col("m0.h")).alias("h0"), F.when(F.col("n2") > 0, F.col("m1.h")).alias("h1")), "key")
    met = met.withColumn("head", F.when(F.col("side") == 0, F.col("h0")).otherwise(F.col("h1"))).where("head IS NOT NULL")
    met = materialise(met.select(F.struct("key", (F.col("side") > 0).alias("star")).alias("bucket"), "side", "h", "e", "head"), "line-buckets")
    pairs = met.select("h", "head").where("h <> head").distinct()
    pairs = pairs.join(rows.select("h", "line"), "h").join(rows.select(F.col("h").alias("head"), F.col("line").alias("other")), "head").select("h", "head", "line", "other")

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield b.filter(pa.array([within_one(x.split(), y.split()) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())).select(["h", "head"])

    near = pairs.mapInArrow(verify, "h binary, head binary").unionByName(met.select("h", "head").where("h = head").distinct())
    return met.join(near, ["h", "head"], "left_semi").drop("head")


def _settled(buckets: DataFrame) -> DataFrame:
    """h, earlier (place of a line that stays) of the lines that go."""
    gone: list[DataFrame] = []
    open_ = materialise(buckets.withColumn("stays", F.lit(False)), "open-lines")
    while True:
        side = lambda s, stays: F.min(F.when((F.col("side") == s) & (F.col("stays") == stays), F.col("e")))
        low = open_.groupBy("bucket").agg(*(side(s, stays).alias(f"{'stays' if stays else 'open'}_{s}") for s in range(3) for stays in (True, False)))
        facing = lambda name: F.when(F.col("side") == 0, F.col(f"{name}_0")).when(F.col("side") == 1, F.col(f"{name}_2")).otherwise(F.col(f"{name}_1"))
        seen = open_.where("NOT stays").join(low, "bucket").select("h", "e", facing("stays").alias("kept"), facing("open").alias("rival"))
        kept, rival = (F.min(F.when(F.col(c) < F.col("e"), F.col(c))) for c in ("kept", "rival"))
        fate = materialise(seen.groupBy("h").agg(kept.alias("earlier"), rival.isNull().alias("free")).where("earlier IS NOT NULL OR free"), "line-fates")
        gone.append(fate.where("earlier IS NOT NULL").select("h", "earlier"))
        if fate.isEmpty():
            break
        left = open_.join(fate.select("h", F.col("earlier").isNotNull().alias("goes")), "h", "left").where("goes IS NULL OR NOT goes")
        open_ = materialise(left.select("bucket", "side", "h", "e", (F.col("stays") | F.col("goes").isNotNull()).alias("stays")), "open-lines")
    out = gone[0]
    for g in gone[1:]:
        out = out.unionByName(g)
    return out


def _dropped(known: DataFrame, min_words: int, near_words: int) -> DataFrame:
    """e, keep (struct ord, row, line_no) of every line that goes, of identified() rows."""
    lines = materialise(_lines(known, min_words, near_words), "lines")
    first = materialise(lines.groupBy("h").agg(F.min("e").alias("e"), F.count("*").alias("c"), F.min("n").alias("n"), F.min("halves").alias("halves")), "first-lines")
    near = _settled(_buckets(known, first, near_words))
    fate = materialise(first.join(near, "h", "left").where("c > 1 OR earlier IS NOT NULL").select("h", F.col("e").alias("first"), "earlier"), "fates")
    own = lines.select("e", "h").join(fate, "h")
    return own.where((F.col("e") > F.col("first")) | F.col("earlier").isNotNull()).select("e", F.coalesce("earlier", "first").alias("keep"))


def dropped_lines(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, line_no (from 0), keep (struct doc_id, line_no of an earlier line that stays) of every line that goes."""
    number = lambda e: F.nullif(e["ord"], F.lit(LAST_ID))
    e, keep = F.col("e"), F.col("keep")
    return _dropped(identified(docs), min_words, near_words).select(number(e).alias("doc_id"), e["line_no"].alias("line_no"), F.struct(number(keep).alias("doc_id"), keep["line_no"].alias("line_no")).alias("keep"))


def clean(docs: DataFrame, min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc (struct of all columns of a row), text (less the repeated lines), n_lines, n_dropped, spent (lines went and nothing but blanks is left)."""
    known = identified(docs)
    drops = _dropped(known, min_words, near_words).groupBy(F.col("e.row").alias("row")).agg(F.array_sort(F.collect_list("e.line_no")).alias("out"))
    drops = materialise(drops, "dropped-lines")
    size = drops.agg(F.sum(4 * F.size("out") + 64)).first()[0] or 0
    if size <= BROADCAST_BYTES // 4:  # then the texts needn't move
        drops = F.broadcast(drops)
    joined = known.join(drops, "row", "left").withColumn("parts", F.split(F.coalesce(F.col("doc.text").cast("string"), F.lit("")), "\n"))
    begin = lambda i: F.coalesce(F.get("out", i - 1), F.lit(-1)) + 1
    end = lambda i: F.coalesce(F.get("out", i), F.size("parts"))
    runs = F.transform(F.sequence(F.lit(0), F.size("out")), lambda i: F.slice("parts", begin(i) + 1, F.greatest(F.lit(0), end(i) - begin(i))))
    text = F.when(F.col("out").isNull(), F.coalesce(F.col("doc.text").cast("string"), F.lit(""))).otherwise(F.concat_ws("\n", F.flatten(runs)))
    out = joined.select("doc", text.alias("text"), F.size("parts").cast("long").alias("n_lines"), F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_dropped"))
    return out.withColumn("spent", (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept (the document stays), text_sha256 of what is left of it."""
    got = clean(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc.doc_id", "n_lines", "n_dropped", (~F.col("spent")).alias("kept"), F.sha2("text", 256).alias("text_sha256"))


ORACLE: dict[str, str] = {}
