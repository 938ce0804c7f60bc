import collections
import hashlib
import math
import re

import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.fixtures import documents, odd_rows, prose
from tomegraph.llm import pii as P

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def valid(kind, m):
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "phone":
        return 10 <= len(d) <= 15
    if kind == "card":
        total = sum(v - 9 * (v > 9) for i, c in enumerate(reversed(d)) for v in [int(c) * (1 + i % 2)])
        return 14 <= len(d) <= 19 and total % 10 == 0
    return True


def brute(text):
    return sorted((m.start(), k, m.end()) for k, (kind, p) in enumerate(KINDS) for m in re.finditer(p, text or "") if valid(kind, m[0]))


HARD = [
    "a@b.c_d@e.fg h@i.j.k@l.m.n", "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.4 1.2.3.0300 9.9.9.9.", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+49 (30) 123-4567 8 +1 2 ++12345678901 +12345678901.",
    "☃𝄞 x@y.zz 漢 10.0.0.1", "378282246310005 6011111111111117 3056930009020004", "1" * 5000, ("7 " * 4000), "@@a@b.c@d.e", "+1 " + "(" * 3000, "a." * 3000 + "@", "4111111111111111" * 3, "x%y+z@q-r.s-t..u", "12.34.56.78@host.org",
    " ".join(f"u{i}@h{i}.org" for i in range(300)),
]


def test_base_spans(spark):
    data = odd_rows() + [(500 + i, t) for i, t in enumerate(HARD)]
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.sanitise(documents(spark, data)).select("doc_id", F.col("base").alias("spans")).collect()}
    assert got == {d: brute(t) for d, t in data}


def test_disclosing_terms(spark):
    secret = [(i, f"{prose(i, 30)} write to Zarquon at zq@corp.example about it {prose(90 + i, 30)}") for i in range(6)]
    plain = [(100 + i, f"{prose(200 + i, 60)} write to me about it at home") for i in range(250)]
    found = P.sanitise(documents(spark, secret + plain + [(999, None), (998, "")])).collect()
    text = dict(secret + plain)
    terms = collections.Counter(text[r.doc_id][s.start : s.stop] for r in found for s in r.spans if s.kind > P.SECRET)
    assert terms["Zarquon"] == 6
    assert set(terms) <= {"Zarquon"} | {w for t in text.values() for w in t.split()}
    assert "write" not in terms
    assert "about" not in terms
    for r in found:
        assert [tuple(s) for s in r.base] == brute(text.get(r.doc_id))
        assert r.base == [s for s in r.spans if s.kind < P.SECRET]
        assert all(a.stop <= b.start for a, b in zip(r.spans, r.spans[1:], strict=False))
    clean = {r.doc_id: r.text for r in P.redact(P.sanitise(documents(spark, secret + plain))).collect()}
    assert set(clean) == set(range(6))
    assert all("[EMAIL]" in t and "Zarquon" not in t and "zq@" not in t for t in clean.values())


def test_empty(spark):
    none = documents(spark, [(1, "a")]).where("doc_id < 0")
    assert P.sanitise(none).count() == 0


def test_query(spark, sf):
    got = P.op2_pii(spark, sf).collect()
    src = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(got) == len(src)
    for r in got:
        b = brute(src[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{KINDS[k][0]}:{s}:{e}" for s, k, e in b).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in b) for i in range(4)]


def added(spark, rows):
    text = dict(rows)
    return collections.Counter(text[r.doc_id][s.start : s.stop] for r in P.sanitise(documents(spark, rows)).collect() for s in r.spans if s.kind > P.SECRET)


def test_values_of_one_text(spark):
    """No value is in two texts: a term that goes with any phone number, and one that goes with a host."""
    plain = [(1000 + i, prose(3000 + i, 40)) for i in range(400)]
    phones = [(i, f"Hotline {prose(i, 60)} +49 30 1234{i:04d} {prose(50 + i, 20)}") for i in range(12)]
    mails = [(100 + i, f"{prose(400 + i, 30)} u{i}@zq.example {prose(500 + i, 60)} Zarquon") for i in range(12)]
    once = [(200, f"Quibble {prose(900, 30)} 10.1.2.3")]
    got = added(spark, phones + mails + once + plain)
    assert got["Hotline"] == got["Zarquon"] == 12
    assert got["Quibble"] == 0


def test_copies_are_one_text(spark):
    same = f"Quibble {prose(1, 30)} 10.1.2.3"
    assert added(spark, [(i, same) for i in range(30)] + [(100 + i, prose(100 + i, 40)) for i in range(400)]) == {}


def secrets(text):
    out = []
    for m in re.finditer(r"(?<![A-Za-z0-9+=])[A-Za-z0-9+=]{20,}", text or ""):
        n = collections.Counter(m[0])
        bits = -sum(c / len(m[0]) * math.log2(c / len(m[0])) for c in n.values())
        free = all(m.end() <= s or m.start() >= e for s, _, e in brute(text))
        if free and bits >= 3 - 1e-12 and re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]):
            out.append((m.start(), 4, m.end()))
    return out


def disclosed(texts):
    """All spans of each distinct text, by counting every pair of entity and term in plain Python."""
    texts = sorted(set(t or "" for t in texts))
    spans = {t: sorted(brute(t) + secrets(t)) for t in texts}
    terms = {t: set(regex.findall(r"\p{L}{3,}", t.lower())) for t in texts}
    held, near = {}, {}
    for t in texts:
        if spans[t]:
            held[t] = set()
            rest, at = [], 0
            for s, k, e in spans[t]:
                value = t[s:e].lower()
                held[t] |= {(False, k, value), (True, k, ""), (True, k, value.split("@")[-1] if k == 0 else "")}
                rest.append(t[at : max(at, s)])
                at = e
            near[t] = set(regex.findall(r"\p{L}{3,}", " ".join([*rest, t[at:]]).lower()))
    n_entity = collections.Counter(e for es in held.values() for e in es)
    n_joint = collections.Counter((e, w) for t, es in held.items() for e in es if n_entity[e] > 1 for w in near[t])
    wanted = {w for (_, w), n in n_joint.items() if n > 1}
    n_term = collections.Counter(w for t in texts for w in terms[t] & wanted)
    kind = {}
    for (e, w), n in n_joint.items():
        if n > 1:
            prior = n_entity[e] / len(texts)
            p = (n + P.POOL * prior) / (n_term[w] + P.POOL) if e[0] else n / n_term[w]
            if p >= P.GENERALISE and math.log2(p / prior) >= P.MIN_BITS:
                kind[e, w] = 6 if p >= P.REMOVE else 5
    out = {}
    for t in texts:
        out[t] = list(spans[t])
        own = {w: max(kind[e, w] for e in held[t] if (e, w) in kind) for w in near.get(t, ()) if any((e, w) in kind for e in held[t])}
        for m in regex.finditer(r"\p{L}{3,}", t) if own else ():
            if m[0].lower() in own and all(m.end() <= s or m.start() >= e for s, _, e in spans[t]):
                out[t].append((m.start(), own[m[0].lower()], m.end()))
        out[t].sort()
    return out


@pytest.mark.parametrize("scale", ["0.001", "0.01"])
def test_all_spans_against_counting(spark, sf, scale):
    """On the given tables the corpus adds terms; every span equals that of a count of all pairs."""
    docs = spark.read.parquet(f"{sf.replace('0.001', scale)}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    want = disclosed(text.values())
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in P.sanitise(docs).collect()}
    assert got == {d: want[t or ""] for d, t in text.items()}
    if scale == "0.01":
        assert sum(s[1] > P.SECRET for spans in got.values() for s in spans) > 0


def test_equal_and_missing_ids(spark):
    """Ids play no part: rows of one id or none get the spans of their texts."""
    rows = [(None, f"Hotline {prose(i, 30)} +49 30 1234{i:04d}") for i in range(12)] + [(7, f"Hotline {prose(i, 30)} +49 30 9234{i:04d}") for i in range(12)] + [(None, prose(900 + i, 40)) for i in range(700)]
    want = disclosed([t for _, t in rows])
    names = [f"{P.KINDS[k]}:{s}:{e}" for t in [t for _, t in rows] for s, k, e in want[t]]
    got = [f"{P.KINDS[s.kind]}:{s.start}:{s.stop}" for r in P.sanitise(documents(spark, rows)).collect() for s in r.spans]
    assert sorted(got) == sorted(names)
    assert sum(n.startswith(("general", "remove")) for n in names) >= 24


def test_secrets(spark):
    data = [(1, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'), (2, "a" * 19 + "1" + " " + "ab1" * 9 + " 12345678901234567890123 abcdefghijklmnopqrstuvwxyz"), (3, "x9Kq27LmPw8Zt4Rb1VnC0s@host.example"), (4, "x9Kq27LmPw8Zt4Rb1Vn")]
    got = {r.doc_id: [(s.start, s.kind, s.stop) for s in r.spans if s.kind == P.SECRET] for r in P.sanitise(documents(spark, data)).collect()}
    assert got == {d: secrets(t) for d, t in data}
    assert [len(v) for _, v in sorted(got.items())] == [1, 0, 0, 0]
