"""Personal data and what gives it away, by DataFrame functions alone.

Protected entities are e-mail and IP addresses, card and telephone numbers, found by patterns and
checked (the base spans), and secrets: tokens of SECRET_CHARS letters and digits or more of at least
SECRET_BITS bits of entropy a character. Then the corpus tells which terms reveal an entity: for a
term (three letters or more) of a text that holds the entity, outside its spans, p = texts with both /
texts with the term, and the pointwise mutual information in bits, log2(p / share of texts with the
entity). Texts are whole and distinct: copies, whatever their ids, are one text. With p >= GENERALISE
and at least MIN_BITS the term discloses the entity: its places in those texts become spans as well,
`general` (replace by a placeholder) or, from REMOVE on, `remove`. An entity is a value, the kind of a
value, or the host of an e-mail address; one that is in a single text has no evidence and reveals
nothing. Shares of kinds and hosts have POOL texts of the corpus's average added to them, so a few
chance meetings don't pass. Terms and secrets that overlap a base span are left to it.

Positions are code points. The patterns are those of the contract written without the backtracking
that long runs would cost: possessive repeats, and no start inside a run that was tried already.

Defined cases: null and empty texts have no spans; rows of equal or null doc_id are rows of their own,
judged by their text alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, materialise, table

GENERALISE, REMOVE, MIN_BITS = 0.5, 0.9, 4.0
#: Texts of average share that are added to those of a pool.
POOL = 4
#: Names by number; spans are sorted by start, then in this order.
KINDS = ("email", "ip", "card", "phone", "secret", "general", "remove")
SECRET = KINDS.index("secret")
SECRET_CHARS, SECRET_BITS = 20, 3.0
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_SECRET = rf"(?<![A-Za-z0-9+=])[A-Za-z0-9+=]{{{SECRET_CHARS},}}+"
_TERM = r"\p{L}{3,}+"
_BLOCK = 64
_SPAN = "array<struct<start: int, kind: int, stop: int>>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often a lambda inside refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stops(units: Column) -> Column:
    """Running sums of an int array in two levels, so that long arrays don't cost their square."""
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def outer(u: Column) -> Column:
        n = F.ceil(F.size(u) / _BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n - 1), lambda b: total(F.slice(u, b * _BLOCK + 1, F.lit(_BLOCK))))
        before = lambda s: F.transform(s, lambda _, b: total(F.slice(s, F.lit(1), b)))
        at = lambda p, i: F.get(p, F.floor(i / _BLOCK).cast("int")) + total(F.slice(u, F.floor(i / _BLOCK).cast("int") * _BLOCK + 1, i % _BLOCK + 1))
        return let(let(blocks, before), lambda p: F.transform(u, lambda _, i: at(p, i)))

    return F.when(F.size(units) > 0, let(units, outer)).otherwise(F.array().cast("array<int>"))


def occurrences(text: Column, pattern: str) -> Column:
    """array<struct<start, stop, value>> of the leftmost, non-overlapping matches."""

    def placed(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern), 1, F.size(found))
        stops = _stops(F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m)))
        return F.zip_with(stops, found, lambda s, m: F.struct((s - F.length(m)).alias("start"), s.alias("stop"), m.alias("value")))

    none = F.array().cast("array<struct<start: int, stop: int, value: string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), 0), lambda m: F.when(F.size(m) > 0, placed(m)).otherwise(none))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _octets(v: Column) -> Column:
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(v, r"\."), lambda p: (F.length(short(p)) < 3) | ((F.length(short(p)) == 3) & (short(p) <= "255")))


def _luhn(v: Column) -> Column:
    """14 to 19 digits; every second one from the right doubled, nines cast out, sum divisible by ten."""
    value = lambda d, i: F.when(i % 2 == 0, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    total = lambda d: F.aggregate(F.transform(F.split(F.reverse(d), ""), lambda c, i: value(F.when(c == "", 0).otherwise(c.try_cast("int")), i)), F.lit(0), lambda a, x: a + x)
    return let(_digits(v), lambda d: F.when(F.length(d).between(14, 19), total(d) % 10 == 0).otherwise(False))


def base_spans(text: Column) -> Column:
    """Checked base spans of a text, sorted."""
    digit = text.rlike("[0-9]")
    kinds = (
        (0, _EMAIL, F.contains(text, F.lit("@")), lambda v: F.lit(True)),
        (1, _IP, digit & F.contains(text, F.lit(".")), _octets),
        (2, _CARD, digit, _luhn),
        (3, _PHONE, F.contains(text, F.lit("+")), lambda v: F.length(_digits(v)).between(10, 15)),
    )

    def of(number: int, pattern: str, may: Column, valid: Callable[[Column], Column]) -> Column:
        ok = F.filter(occurrences(text, pattern), lambda m: valid(m["value"]))
        spans = F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["stop"].alias("stop")))
        return F.when(may, spans).otherwise(F.array().cast(_SPAN))

    return F.array_sort(F.concat(*(of(*k) for k in kinds)))


def _entropy(v: Column) -> Column:
    """Bits a character."""
    share = lambda cs, c: F.size(F.filter(cs, lambda x: x == c)) / F.size(cs)
    total = lambda cs: F.aggregate(F.array_distinct(cs), F.lit(0.0), lambda a, c: a - share(cs, c) * F.log2(share(cs, c)))
    return let(F.split(v, ""), total)


def secret_spans(text: Column, base: Column) -> Column:
    """Spans of secrets that touch none of the base spans."""
    free = lambda m: ~F.exists(base, lambda s: (s["start"] < m["stop"]) & (s["stop"] > m["start"]))
    mixed = lambda v: v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    ok = F.filter(occurrences(text, _SECRET), lambda m: mixed(m["value"]) & free(m) & (_entropy(m["value"]) >= SECRET_BITS))
    spans = F.transform(ok, lambda m: F.struct(m["start"].alias("start"), F.lit(SECRET).alias("kind"), m["stop"].alias("stop")))
    return F.when(text.rlike(rf"[A-Za-z0-9+=]{{{SECRET_CHARS}}}"), spans).otherwise(F.array().cast(_SPAN))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, spans (base ones and secrets), text (null where there are none) of every document."""
    t = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    spans = t.withColumn("base", base_spans(F.col("text")))
    spans = spans.withColumn("spans", F.array_sort(F.concat("base", secret_spans(F.col("text"), F.col("base")))))
    return materialise(spans.select("doc_id", "spans", F.when(F.size("spans") > 0, F.col("text")).alias("text")), "pii")


def _entities(text: Column, spans: Column) -> Column:
    """array<struct<pooled, entity>>: each value, and as pools its kind and an e-mail address's host."""

    def of(s: Column) -> Column:
        value = F.lower(F.substr(text, s["start"] + 1, s["stop"] - s["start"]))
        host = F.when(s["kind"] == KINDS.index("email"), F.substring_index(value, "@", -1)).otherwise("")
        named = lambda pooled, name: F.struct(F.lit(pooled).alias("pooled"), F.xxhash64(F.lit(pooled), s["kind"], name).alias("entity"))
        return F.array(named(False, value), named(True, F.lit("")), named(True, host))

    return F.array_distinct(F.flatten(F.transform(spans, of)))


def _outside(text: Column, spans: Column) -> Column:
    """The text with a blank for each span."""
    begin = lambda i: F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
    pieces = F.transform(spans, lambda s, i: F.substr(text, begin(i) + 1, F.greatest(F.lit(0), s["start"] - begin(i))))
    return F.concat(F.concat_ws(" ", pieces), F.lit(" "), F.substr(text, F.element_at(spans, -1)["stop"] + 1))


def _sent(df: DataFrame, bytes_each: int) -> DataFrame:
    return F.broadcast(df) if df.count() * bytes_each <= BROADCAST_BYTES // 4 else df


def disclosing(docs: DataFrame, found: DataFrame) -> DataFrame:
    """copy (hash of a text), term, kind (number) of the terms that reveal a value of that text."""
    rows = found.where("text IS NOT NULL").select(F.xxhash64("text").alias("copy"), "text", "spans").dropDuplicates(["copy"])
    terms_of = lambda t: F.array_distinct(F.regexp_extract_all(F.lower(t), F.lit(_TERM), 0))
    texts = rows.select("copy", _entities(F.col("text"), F.col("spans")).alias("es"), terms_of(let(F.struct("text", "spans"), lambda r: _outside(r["text"], r["spans"]))).alias("terms"))
    texts = materialise(texts, "pii-texts")
    all_copies = docs.select(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("copy")).groupBy("copy").agg(F.count("*").alias("n_copies"))
    all_copies = materialise(all_copies, "pii-copies")
    n_texts = float(max(all_copies.count(), 1))
    each = texts.select("copy", F.explode("es").alias("e")).select("copy", "e.*")
    # an entity of one text has no evidence of its own; its pools have
    held = materialise(each.groupBy("entity", "pooled").agg(F.count("*").alias("n_entity")).where("n_entity > 1"), "pii-entities")
    shared = each.join(_sent(held, 64), ["entity", "pooled"]).groupBy("copy").agg(F.collect_list(F.struct("entity", "pooled", "n_entity")).alias("es"))
    context = texts.drop("es").join(shared, "copy").select("copy", "terms", F.explode("es").alias("e")).select("copy", "e.*", F.explode("terms").alias("term"))
    context = materialise(context, "pii-context")
    prior = F.col("n_entity") / n_texts
    share = lambda n: F.when(F.col("pooled"), (F.col("n_joint") + POOL * prior) / (n + POOL)).otherwise(F.col("n_joint") / n)
    enough = lambda p: (p >= GENERALISE) & (F.log2(p / prior) >= MIN_BITS)
    joint = context.groupBy("entity", "pooled", "n_entity", "term").agg(F.count("*").alias("n_joint")).where("n_joint > 1")
    joint = materialise(joint.where(enough(share(F.col("n_joint")))), "pii-joint")  # a term is in n_joint texts at least
    terms = materialise(joint.select("term").distinct(), "pii-terms")
    own = docs.select(F.xxhash64("text").alias("copy"), F.explode(terms_of(F.col("text").cast("string"))).alias("term"))
    size = terms.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    own = own.join(F.broadcast(terms) if size <= BROADCAST_BYTES // 2 else terms, "term", "left_semi")
    weighed = own.join(_sent(all_copies.where("n_copies > 1"), 64), "copy", "left")
    counts = weighed.groupBy("term").agg(F.round(F.sum(1 / F.coalesce("n_copies", F.lit(1)))).alias("n_term"))
    p = share(F.col("n_term"))
    kind = F.when(p >= REMOVE, KINDS.index("remove")).otherwise(KINDS.index("general"))
    reveals = joint.join(counts, "term").where(enough(p)).select("entity", "term", kind.alias("kind"))
    return materialise(context.select("copy", "entity", "term").join(reveals, ["entity", "term"]).groupBy("copy", "term").agg(F.max("kind").alias("kind")), "pii-reveals")


def sanitise(docs: DataFrame) -> DataFrame:
    """doc_id, base (array), spans (array with the added ones), clean_text (null where nothing was found)."""
    found = find(docs)
    terms = disclosing(docs, found).groupBy(F.col("copy").alias("_d")).agg(F.map_from_entries(F.collect_list(F.struct("term", "kind"))).alias("_terms"))
    some = found.where("text IS NOT NULL").join(terms, F.xxhash64("text") == F.col("_d"), "left").drop("_d")
    kind = lambda m: F.col("_terms")[F.lower(m["value"])]
    free = lambda m: ~F.exists("spans", lambda s: (s["start"] < m["stop"]) & (s["stop"] > m["start"]))
    hit = F.filter(occurrences(F.col("text"), _TERM), lambda m: kind(m).isNotNull() & free(m))
    added = F.transform(hit, lambda m: F.struct(m["start"].alias("start"), kind(m).alias("kind"), m["stop"].alias("stop")))
    some = some.withColumn("added", F.when(F.col("_terms").isNull(), F.array().cast(_SPAN)).otherwise(added))
    base = F.filter("spans", lambda s: s["kind"] < SECRET).alias("base")
    some = some.select("doc_id", base, F.array_sort(F.concat("spans", "added")).alias("spans"), "text")
    none = found.where("text IS NULL").select("doc_id", F.col("spans").alias("base"), "spans", "text")
    return some.unionByName(none)


def redact(found: DataFrame) -> DataFrame:
    """doc_id and the text of sanitise() with spans replaced by placeholders; removed terms leave nothing."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:-1]), F.lit(""))

    def text(spans: Column) -> Column:
        begin = lambda i: F.coalesce(F.get(spans, i - 1)["stop"], F.lit(0))
        piece = lambda s, i: F.concat(F.substr("text", begin(i) + 1, F.greatest(F.lit(0), s["start"] - begin(i))), F.get(names, s["kind"]))
        return F.concat(F.concat_ws("", F.transform(spans, piece)), F.substr(F.col("text"), F.element_at(spans, -1)["stop"] + 1))

    return found.where("text IS NOT NULL").select("doc_id", let(F.col("spans"), text).alias("text"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sanitise(table(spark, sf_dir, "documents"))
    names = F.array(*(F.lit(k) for k in KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    count = lambda i: F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long")
    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:SECRET])]
    other = lambda test, name: F.size(F.filter("spans", lambda s: test(s["kind"]))).cast("long").alias(name)
    more = [other(lambda k: k == SECRET, "n_secret"), other(lambda k: k > SECRET, "n_terms"), F.size("spans").cast("long").alias("n_spans")]
    return got.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), *more)


ORACLE: dict[str, str] = {}
