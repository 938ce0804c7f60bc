import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tests.llm.fixtures import documents, odd_rows, prose
from tomegraph.llm import packing as P
from tomegraph.llm import token_file as F
from tomegraph.llm.common import scratch_path, slices
from tomegraph.llm.tokens import Encoder, vocabulary

HARD = [None, "", " ", "\x0b a\x0c\x1cb\x85c d  e", "a<|endoftext|>b <|startoftext|>", "x" * 9000, "\x00 \x00a", "é́ ́a ΑΣ Σ ς", "'s 't don'T 12 ½ ²", "　z y", "Zürich, ÉLAN. ßÿ", "i̇İ ﬁ ǅ"]


def plain(texts, end):
    t = Tokenizer.from_file(vocabulary())
    return [[*t.encode(x or "", add_special_tokens=False).ids, end] for x in texts]


def test_encoder_equals_the_library():
    e = Encoder(vocabulary())
    assert e.exact_chunks
    assert e.plain
    texts = HARD + [t for _, t in odd_rows()]
    for _ in range(2):  # the second time from the cache
        assert [[*x.tolist(), 2] for x in e.many(texts)] == plain(texts, 2)
    e.plain = e.exact_chunks = False
    assert [[*x.tolist(), 2] for x in e.many(HARD)] == plain(HARD, 2)


@pytest.mark.parametrize(("size", "n", "least"), [(F.FILE_TOKENS, F.FILE_DOCS, 1), (2000, 5, 6)])
def test_files_round_trip(spark, size, n, least):
    data = odd_rows() + [(300 + i, t) for i, t in enumerate(HARD)]
    ids = dict(zip([d for d, _ in data], plain([t for _, t in data], 2), strict=True))
    manifest = F.write(documents(spark, data), scratch_path(spark, "t"), vocabulary(), 2, partitions=3, file_tokens=size, file_docs=n)
    assert manifest.count() >= least and manifest.where(f"n_docs > {n}").count() == 0
    at, want = 0, {}
    for d in sorted(ids):
        want[d] = (d, at, len(ids[d]), zlib.crc32(np.array(ids[d], "<u4").tobytes()))
        at += len(ids[d])
    assert {r.doc_id: tuple(r) for r in F.read(manifest).collect()} == want
    for m in manifest.collect():
        got = F.fetch(manifest, m.path, [12, 10, 999])
        assert all(got[d] == ids[d] for d in got)


def test_reader_decodes_only_what_is_asked(tmp_path):
    path = tmp_path / "x"
    with path.open("wb") as f:
        w = F.Writer(f)
        docs = [np.arange(i, i + n, dtype=np.uint32) for i, n in enumerate([1, 100_000, 5, 70_000, 0, 3])]
        for i, x in enumerate(docs):
            w.add(i, x)
        w.close()
    with path.open("rb") as f:
        r = F.Reader(f, path.stat().st_size)
        assert len(r.frames) > 4
        assert (r.ids(5) == docs[5]).all()
        assert r.decoded == 1
        assert all((r.ids(i) == x).all() for i, x in enumerate(docs))
    raw = bytearray(path.read_bytes())
    raw[20] ^= 1
    path.write_bytes(raw)
    with path.open("rb") as f, pytest.raises(Exception):  # noqa: B017, PT011  the frame or its checksum
        F.Reader(f, len(raw)).ids(1)


def test_empty_tables(spark):
    none = documents(spark, [(1, "a")]).where("doc_id < 0")
    assert F.read(F.write(none, scratch_path(spark, "t"), vocabulary(), 2)).count() == 0
    assert P.pack(P.pieces(none, vocabulary(), 1, 64), 64).count() == 0


@pytest.mark.parametrize("partition", [5, 10_000])
def test_packing(spark, partition):
    data = odd_rows() + [(400 + i, prose(i, 5 + 7 * i)) for i in range(40)]
    ids = dict(zip([d for d, _ in data], plain([t for _, t in data], 1), strict=True))
    rows = P.pack(P.pieces(documents(spark, data), vocabulary(), 1, 256), 256, partition).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(part.tobytes())
        assert r.start == 256 * r.piece
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        by_seq.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert by_doc == {d: len(x) for d, x in ids.items()}
    for places in by_seq.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 256
    least = -(-sum(map(len, ids.values())) // 256)
    assert len(by_seq) <= (least + 1 if partition > 100 else 1.2 * least)


def test_bounds_hold():
    r = np.random.default_rng(1)
    for _ in range(40):
        lengths = r.integers(1, 101, r.integers(1, 60))
        bins, offsets, filled = P.best_fit_decreasing(lengths, 100)
        assert P.lower_bound(lengths, 100) <= len(filled)
        assert filled.max() <= 100
        assert (np.bincount(bins, lengths) == filled).all()
    assert P.lower_bound(np.array([51] * 7), 100) == 7
    assert P.lower_bound(np.array([34] * 6), 100) == 3
    assert P.lower_bound(np.zeros(0, np.int64), 100) == 0


def test_token_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    at, want = 0, set()
    for d, ids in zip(sorted(docs), plain([docs[d] for d in sorted(docs)], 2), strict=True):
        want.add((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = F.op7_token_frames(spark, sf)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert {tuple(r) for r in got.collect()} == want


def test_one_id_over_several_files(spark):
    data = [(3, prose(i, 30)) for i in range(200)] + [(None, prose(i, 20)) for i in range(100)] + [(1, "a")]
    manifest = F.write(documents(spark, data).coalesce(1), scratch_path(spark, "t"), vocabulary(), 2, partitions=6)
    assert max(r.n_docs for r in manifest.collect()) < 150
    rows = sorted(F.read(manifest).collect(), key=lambda r: r.start)
    order = sorted(range(len(data)), key=lambda i: (data[i][0] is not None, data[i][0] or 0, i))
    want = plain([data[i][1] for i in order], 2)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows] == [(data[i][0], len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in zip(order, want, strict=True)]
    assert [r.start for r in rows] == np.cumsum([0, *map(len, want)])[:-1].tolist()


def test_packing_query(spark, sf):
    """Every id of every document once, gapless sequences, and as few of them as the bound over all pieces allows."""
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = dict(zip(docs, plain(list(docs.values()), 1), strict=True))
    got = P.op8_best_fit_packing(spark, sf)
    rows = got.collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted((d, k, at, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for d, x in ids.items() for k, at in enumerate(range(0, len(x), 4096)))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places)])[:-1].tolist()
        assert sum(n for _, n in places) <= 4096
    bound = P.total_bound(got.select("length"), 4096)
    assert bound == P.lower_bound(np.array([r.length for r in rows]), 4096)
    assert bound <= len(by) <= bound + 1


def test_workers_drop_the_vocabulary_for_other_stages(spark):
    """What tokenizing tasks keep in a Python worker goes when a task of another stage slices its texts there."""

    def left(it):
        import gc

        for _ in slices(it):
            pass
        gc.collect()
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Encoder" for x in gc.get_objects())])], ["n"])

    docs = documents(spark, odd_rows()).repartition(4)
    P.pieces(docs, vocabulary(), 1, 64).write.format("noop").mode("overwrite").save()
    assert {r.n for r in spark.range(400).repartition(8).mapInArrow(left, "n long").collect()} == {0}
