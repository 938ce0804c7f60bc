"""Chat formatting in budgeted windows, by DataFrame functions alone.

Turn tokens (runs of non-blank characters plus the template's own) are summed along a conversation.
With room = budget - history - the system turn's tokens, a turn belongs to the span of room / 2
tokens in which it starts, and a turn longer than that is a span of its own, so a span never exceeds
the room unless a single turn does (over_budget; texts are never cut). Each span becomes a window:
the system turn, then the turns before the span that start within `history` tokens of it, then the
span. Only assistant texts of the span itself are under the loss mask; those repeated are not.

Turns are written as `<s>[ROLE:role]\\ntext</s>\\n`. Inside roles and texts the characters `\\ < [ ]`
become `\\0 \\1 \\2 \\3`, so no text can hold a control string, and unescape() gives it back.

A conversation may be of any length: turns are range-partitioned by their order, a conversation's part
in a partition is a block, and sums along it are taken within blocks and over the blocks' totals, so
no task sees more of it than a block. Windows are bounded by the budget.

Defined cases: null text and role are empty; turns go by turn, role, text (null turns first); equal
rows are turns of their own; a null conv_id is a conversation; an empty table gives no rows; other
columns are ignored. The query's digests read a conversation as a whole, the operator never does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialise, shuffle_partitions, table

BUDGET, HISTORY = 2048, 512
#: Tokens that the template adds to a turn.
TURN_TOKENS = 4
#: Windows of a conversation that share a copy of its system turn.
SYSTEM_SHARE = 1000
_ESCAPES = (("\\", "\\0"), ("<", "\\1"), ("[", "\\2"), ("]", "\\3"))


def escape(c: Column) -> Column:
    for plain, code in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def _placed(turns: DataFrame, partitions: int) -> DataFrame:
    """conv (struct conv_id), block, pos (rising with the order of all turns), role, text, tokens."""
    t = turns.select(F.struct("conv_id").alias("conv"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("tie", F.monotonically_increasing_id())  # rows that are equal in all else may be split as well
    order = ["conv", "turn", "role", "text", "tie"]
    t = t.repartitionByRange(partitions, *order).sortWithinPartitions(*order).withColumn("pos", F.monotonically_increasing_id())
    tokens = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long") + TURN_TOKENS
    return materialise(t.select("conv", F.shiftright("pos", 33).alias("block"), "pos", "role", "text", tokens.alias("tokens")), "turns")


def _blocks(placed: DataFrame, budget: int, history: int) -> DataFrame:
    """Per conversation and block: half (tokens of a span), system (its turn's place, tokens; or null), tokens before the block and the block's last turn before that."""
    first = F.min_by(F.struct("pos", "role", "tokens"), "pos").alias("first")
    b = placed.groupBy("conv", "block").agg(first, F.count("*").alias("n"), F.sum("tokens").alias("sum"), F.max_by("tokens", "pos").alias("last"))
    along = Window.partitionBy("conv").orderBy("block")  # at most one row a partition
    b = b.withColumns({"head": F.first("first").over(along), "number": F.row_number().over(along)})
    own = (F.col("number") == 1) & (F.col("head.role") == "system")
    b = b.withColumn("system", F.when(F.col("head.role") == "system", F.struct("head.pos", "head.tokens")))
    b = b.withColumns({"n": F.col("n") - own.cast("long"), "sum": F.col("sum") - F.when(own, F.col("system.tokens")).otherwise(0), "half": F.greatest(F.lit(16), F.floor((budget - history - F.coalesce(F.col("system.tokens"), F.lit(0))) / 2))})
    some = b.where("n > 0").withColumn("before", F.sum("sum").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("sum")).withColumn("last_before", F.lag("last").over(along))
    alone = b.where("n = 0 AND number = 1").withColumns({"before": F.lit(None).cast("long"), "last_before": F.lit(None).cast("long")})
    return materialise(some.unionByName(alone).select("conv", "block", "n", "system", "half", "before", "last_before"), "turn-blocks")


def _spans(placed: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv, pos, at, span, opens, system of every turn but the system ones."""
    t = placed.select("conv", "block", "pos", "tokens").join(blocks, ["conv", "block"]).where("n > 0 AND (system IS NULL OR pos <> system.pos)")
    inside = Window.partitionBy("conv", "block").orderBy("pos")
    t = t.withColumn("at", F.col("before") + F.sum("tokens").over(inside) - F.col("tokens"))
    cell = lambda at: F.floor(at / F.col("half"))
    t = t.withColumn("own", F.struct((F.col("tokens") > F.col("half")).alias("long"), cell(F.col("at")).alias("cell")))
    over = F.when(F.col("last_before").isNotNull(), F.struct((F.col("last_before") > F.col("half")).alias("long"), cell(F.col("before") - F.col("last_before")).alias("cell")))
    t = t.withColumn("prior", F.coalesce(F.lag("own").over(inside), over))
    t = t.withColumn("opens", F.col("prior").isNull() | F.col("own.long") | F.col("prior.long") | (F.col("own.cell") != F.col("prior.cell")))
    t = t.withColumn("nth", F.sum(F.col("opens").cast("long")).over(inside))
    t = materialise(t.select("conv", "block", "pos", "at", "opens", "nth", "system"), "turn-spans")
    before = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = t.groupBy("conv", "block").agg(F.max("nth").alias("opened")).withColumn("base", F.coalesce(F.sum("opened").over(before), F.lit(0)))
    return t.join(base.select("conv", "block", "base"), ["conv", "block"]).withColumn("span", F.col("base") + F.col("nth"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, partitions: int | None = None) -> DataFrame:
    """One row per window: conv_id, window_no, text, n_repeated, loss (array of start, stop), n_tokens, over_budget."""
    placed = _placed(turns, partitions or shuffle_partitions(turns.sparkSession))
    blocks = _blocks(placed, budget, history)
    spans = materialise(_spans(placed, blocks), "turn-windows")
    # the spans that open within `history` tokens after a turn's start repeat it
    cell = F.floor(F.col("at") / max(history, 1))
    opening = spans.where("opens").select("conv", cell.alias("cell"), F.col("at").alias("opens_at"), F.col("span").alias("window_no"))
    ahead = spans.select("conv", "pos", "at", F.explode(F.array(cell, cell + 1)).alias("cell"))
    again = ahead.join(opening, ["conv", "cell"]).where((F.col("opens_at") > F.col("at")) & (F.col("opens_at") <= F.col("at") + history))
    share = lambda n: F.floor(n / SYSTEM_SHARE)
    own = spans.select("conv", F.col("span").alias("window_no"), "pos", F.lit(False).alias("repeated"), F.lit(0).cast("long").alias("copy"))
    again = again.select("conv", "window_no", "pos", F.lit(True).alias("repeated"), F.lit(0).cast("long").alias("copy"))
    # a conversation that is nothing but its system turn is a window as well
    numbers = spans.where("opens AND system IS NOT NULL").select("conv", F.col("span").alias("window_no"), "system")
    numbers = numbers.unionByName(blocks.where("before IS NULL").select("conv", F.lit(1).cast("long").alias("window_no"), "system"))
    system = numbers.select("conv", "window_no", F.col("system.pos").alias("pos"), (F.col("window_no") > 1).alias("repeated"), share(F.col("window_no")).alias("copy"))
    copies = numbers.groupBy(F.col("system.pos").alias("pos")).agg(share(F.max("window_no")).alias("copies"))
    texts = placed.join(copies, "pos", "left").select("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("copies", F.lit(0).cast("long")))).alias("copy"), "role", "text", "tokens")
    pieces = own.unionByName(again).unionByName(system).join(texts, ["pos", "copy"])
    piece = F.struct("pos", "repeated", "role", "text", "tokens")
    w = pieces.groupBy("conv", "window_no").agg(F.array_sort(F.collect_list(piece)).alias("turns"))
    return _written(w.select("conv.conv_id", "window_no", "turns"), budget)


def _written(w: DataFrame, budget: int) -> DataFrame:
    """Texts of windows and the places of their targets, in code points."""
    header = lambda x: F.concat(F.lit("<s>[ROLE:"), escape(x["role"]), F.lit("]\n"))
    w = w.withColumn("parts", F.transform("turns", lambda x: F.struct(header(x).alias("head"), escape(x["text"]).alias("body"), ((x["role"] == "assistant") & ~x["repeated"]).alias("target"))))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + 5
    before = lambda i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda a, p: a + size(p))
    place = lambda p, i: F.struct((before(i) + F.length(p["head"])).alias("start"), (before(i) + F.length(p["head"]) + F.length(p["body"])).alias("stop"), p["target"].alias("target"))
    spans = F.filter(F.transform("parts", place), lambda s: s["target"])
    tokens = F.aggregate("turns", F.lit(0).cast("long"), lambda a, x: a + x["tokens"])
    return w.select(
        "conv_id",
        "window_no",
        F.concat_ws("", F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit("</s>\n")))).alias("text"),
        F.size(F.filter("turns", lambda x: x["repeated"])).alias("n_repeated"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"))).alias("loss"),
        tokens.alias("n_tokens"),
        (tokens > budget).alias("over_budget"),
    )


def read_back(w: DataFrame) -> DataFrame:
    """Per window: its new turns (role, text), unescaped, and the text under the loss mask, from the written text."""
    parts = F.split("text", "</s>\n")
    fresh = F.slice(parts, F.col("n_repeated") + 1, F.size(parts) - 1 - F.col("n_repeated"))
    turn = lambda p: F.struct(
        unescape(F.regexp_extract(p, r"^<s>\[ROLE:([^\]]*)\]", 1)).alias("role"), unescape(F.substr(p, F.instr(p, "]\n") + 2)).alias("text")
    )
    target = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["stop"] - s["start"])))
    return w.select("conv_id", "window_no", F.length("text").alias("chars"), F.transform(fresh, turn).alias("turns"), F.concat_ws("", target).alias("loss_text"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    got = read_back(windows(turns.unionByName(own)))
    line = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    each = got.select("conv_id", F.struct("window_no", F.concat_ws("", line).alias("all"), "loss_text").alias("w"), F.size("turns").alias("n"), "chars")
    by = each.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum(F.col("chars").cast("long")).alias("formatted_chars"), F.array_sort(F.collect_list("w")).alias("w"))
    loss = F.concat_ws("", F.transform("w", lambda x: x["loss_text"]))
    return by.select("conv_id", F.col("n_turns").cast("long").alias("n_turns"), F.sha2(F.concat_ws("", F.transform("w", lambda x: x["all"])), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


ORACLE: dict[str, str] = {
    "op1_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, row_number() OVER w AS seq, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) + {TURN_TOKENS} AS tokens,
 16 + length(role) + length(regexp_replace(role, '[^\\\\<\\[\\]]', '', 'g')) + length(text) + length(regexp_replace(text, '[^\\\\<\\[\\]]', '', 'g')) AS chars FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
y AS (SELECT *, seq = 1 AND role = 'system' AS sys, coalesce(max(tokens) FILTER (WHERE seq = 1 AND role = 'system') OVER (PARTITION BY conv_id), 0) AS head FROM s),
b AS (SELECT *, sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq) - tokens AS begun, greatest(16, ({BUDGET} - {HISTORY} - head) // 2) AS half FROM y WHERE NOT sys),
o AS (SELECT *, coalesce(tokens > half OR lag(tokens > half) OVER w OR begun // half <> lag(begun // half) OVER w, true) AS opens FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY seq)),
x AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY conv_id ORDER BY begun RANGE BETWEEN 1 FOLLOWING AND {HISTORY} FOLLOWING) AS later FROM o),
f AS (SELECT conv_id, sum(chars * (1 + later)) AS chars, count(*) FILTER (WHERE opens) AS n FROM x GROUP BY conv_id)
SELECT y.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256, coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
 (coalesce(any_value(f.chars), 0) + coalesce(sum(y.chars) FILTER (WHERE sys), 0) * coalesce(any_value(f.n), 1))::BIGINT AS formatted_chars
FROM y LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM y.conv_id GROUP BY y.conv_id"""
}
