"""Secret scans: fixed patterns, and sliding-window Shannon entropy over candidate strings.

Entropy is held as a whole number: with counts k over a window of w characters, H = log2 w - S / w where
S is the sum of k log2 k. Moving the window by one character changes two counts, so S is kept up by two table
look-ups. The table holds k log2 k in millionths, which makes the decision exact and the same in any engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import table

#: Fixed patterns of the base scan: kind, pattern, group whose length counts, least length.
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
KINDS = ("assign", "access", "hex", "entropy")


@dataclass(frozen=True)
class CharClass:
    """Candidates made of one character class, the window over them, and the least entropy in bits."""

    name: str
    members: str
    window: int
    bits: float

    @property
    def most(self) -> int:
        """The largest S, in millionths, that still means ``bits`` of entropy."""
        return math.floor(self.window * (math.log2(self.window) - self.bits) * 1e6)


HEX = CharClass("hex", "0123456789abcdefABCDEF", 20, 3.0)
BASE64 = CharClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.5)
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
assert HEX.window == BASE64.window
#: Counters in a long, and the bits of each: they count to the window's size.
PACKED, BITS = 12, 5
#: Matches of a text walked in one block.
AT_ONCE = 256
#: Candidates that hold one of these, in any case, are placeholders and not secrets.
ALLOWED = ("example", "sample", "placeholder", "changeme", "0123456789", "abcdefghij", "deadbeef")


def klogk(most: int) -> list[int]:
    return [0] + [round(k * math.log2(k) * 1e6) for k in range(1, most + 1)]


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out a single time, however often it is used."""
    return F.transform(F.array(value), use)[0]


def spans_of(text: Column, pattern: str, group: int, least: int) -> Column:
    """array<struct<s,e,v>> of the matches, in code points: the pieces between matches give the places. Matches are walked
    in blocks of AT_ONCE, whose places are then shifted, so that the work follows their number."""
    kind = "struct<at:int,out:array<struct<s:int,e:int,v:string>>>"
    none = F.expr(f"CAST(named_struct('at', 0, 'out', array()) AS {kind})")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["before"])
        end = start + F.length(x["all"])
        one = F.array(F.struct(start.alias("s"), end.alias("e"), x["part"].alias("v")))
        out = F.when(F.length(x["part"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"])
        return F.struct(end.alias("at"), out.alias("out")).cast(kind)

    def shifted(blocks: Column) -> Column:
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda at, x: F.concat(at, F.array(F.element_at(at, -1) + x["at"])))
        moved = F.zip_with(blocks, F.slice(starts, 1, F.size(blocks)), lambda x, at: F.transform(x["out"], lambda m: F.struct((m["s"] + at).alias("s"), (m["e"] + at).alias("e"), m["v"].alias("v"))))
        return F.flatten(moved)

    def walked(found: Column) -> Column:
        inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
        pieces = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(found)), found, inner).cast("array<struct<before:string,all:string,part:string>>")
        blocks = lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / AT_ONCE).cast("int")), lambda k: F.aggregate(F.slice(p, k * AT_ONCE + 1, AT_ONCE), none, step))
        return F.when(F.size(found) > 0, once(once(pieces, blocks), shifted)).otherwise(none["out"])

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), walked)


def least_s(value: Column, window: int) -> Column:
    """The least S over all windows of the candidate, by counts that two characters change at each step.

    The counts of the characters, PACKED of BITS bits, ride in each of a few longs. A character's code is 64 times the
    number of its long plus the shift within it. BASE64 holds the characters of any candidate.
    """
    f = F.expr("array(" + ",".join(f"{x}L" for x in klogk(window)) + ")")
    table = [0] * 128
    for k, c in enumerate(BASE64.members):
        table[ord(c)] = k // PACKED * 64 + k % PACKED * BITS
    code_of = F.expr("array(" + ",".join(map(str, table)) + ")")
    longs = -(-len(BASE64.members) // PACKED)
    kind = "struct<c:array<bigint>,s:bigint,best:bigint>"
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), longs).alias("c"), F.lit(0).cast("long").alias("s"), F.lit(2**62).alias("best")).cast(kind)
    slot, one = lambda c: F.shiftright(c, 6), F.lit(1).cast("long")

    def count(counts: Column, c: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(counts, slot(c)), c.bitwiseAND(63)).bitwiseAND(2**BITS - 1).cast("int")

    def step(acc: Column, x: Column) -> Column:
        """One character in, and from the first full window on one out; the window before counts if it was full."""
        come, gone, lone = x["come"], x["gone"], x["gone"] < 0
        left = count(acc["c"], gone)
        right = count(acc["c"], come) - F.when(come == gone, 1).otherwise(0)
        out = F.when(lone, F.lit(0).cast("long")).otherwise(F.get(f, left - 1) - F.get(f, left))
        part = lambda c, j: F.when(slot(c) == j, F.call_function("shiftleft", one, c.bitwiseAND(63))).otherwise(0)
        counts = F.transform(acc["c"], lambda v, j: v + part(come, j) - F.when(lone, F.lit(0).cast("long")).otherwise(part(gone, j)))
        return F.struct(
            counts.alias("c"), (acc["s"] + out + F.get(f, right + 1) - F.get(f, right)).alias("s"),
            F.when(x["full"], F.least(acc["best"], acc["s"])).otherwise(acc["best"]).alias("best"),
        ).cast(kind)

    def over(codes: Column) -> Column:
        moves = F.transform(codes, lambda c, i: F.struct(c.alias("come"), F.when(i >= window, F.get(codes, i - window)).otherwise(-1).alias("gone"), (i >= window).alias("full")))
        return F.aggregate(moves, start, step, lambda acc: F.least(acc["best"], acc["s"]))

    return once(F.transform(F.split(value, ""), lambda c: F.get(code_of, F.ascii(c))), over)


def is_secret(value: Column) -> Column:
    """A letter and a digit, no allow-listed part, and one window of high entropy for its character class."""
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(f"(?i){'|'.join(ALLOWED)}")
    most = F.when(value.rlike("^[0-9a-fA-F]+$"), HEX.most).otherwise(BASE64.most)
    return F.when(mixed, least_s(value, BASE64.window) <= most).otherwise(False)


def _join(spans: Column) -> Column:
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame) -> DataFrame:
    """All secrets of every text: doc_id, n_assign, n_access, n_hex, n_entropy, base_spans and spans (arrays of
    start, kind number, end in code points, sorted), base_sha256 and the joined ``spans`` string.

    A null text counts as empty and has no spans. Patterns match leftmost and without overlap, each kind by itself;
    matches that are too short are dropped after they have consumed their text. An entropy span that lies
    wholly in a base span adds nothing and is left out. Repeated rows, null or repeated ids give a result each; an empty
    table gives an empty result; other columns are ignored. The work grows with a text's length, also in one long candidate.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        *[spans_of(text, pattern, group, least).alias(kind) for kind, pattern, group, least in BASE],
        spans_of(text, CANDIDATE, 0, 20).alias("candidates"),
    )
    shape = "array<struct<s:int,k:int,e:int>>"

    def tagged(col: Column, k: int) -> Column:
        return F.transform(col, lambda x: F.struct(x["s"].alias("s"), F.lit(k).alias("k"), x["e"].alias("e"))).cast(shape)

    base = F.sort_array(F.concat(*[tagged(F.col(kind), i + 1) for i, (kind, *_) in enumerate(BASE)]))
    found = found.select("doc_id", *[F.size(kind).cast("long").alias(f"n_{kind}") for kind, *_ in BASE], base.alias("base_spans"), "candidates")
    fresh = F.filter(
        F.col("candidates"),
        lambda c: is_secret(c["v"]) & ~F.exists("base_spans", lambda b: (b["s"] <= c["s"]) & (b["e"] >= c["e"])),
    )
    extra = tagged(F.when(F.size("candidates") > 0, fresh).otherwise(F.col("candidates")), len(BASE) + 1)
    found = found.select("doc_id", "n_assign", "n_access", "n_hex", "base_spans", extra.alias("extra"))
    found = found.withColumn("all_spans", F.sort_array(F.concat("base_spans", "extra")))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("extra").cast("long").alias("n_entropy"), "base_spans", "all_spans",
        F.sha2(_join(F.col("base_spans")), 256).alias("base_sha256"), _join(F.col("all_spans")).alias("spans"),
    )


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("base_spans", "all_spans")


def _oracle() -> str:
    """The same rows by unnesting: every window is counted afresh."""
    parts = []
    q = lambda s: s.replace("'", "''")
    for k, (kind, pattern, group, least) in enumerate([*BASE, ("entropy", CANDIDATE, 0, 20)], 1):
        parts.append(f"""SELECT doc_id, {k} AS k, i, m[i] AS m, v[i] AS v,
          CAST(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s
          FROM (SELECT doc_id, m, v, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{q(pattern)}') AS m,
            regexp_extract_all(text, '{q(pattern)}', {group}) AS v, regexp_split_to_array(text, '{q(pattern)}') AS g FROM d)) WHERE length(v[i]) >= {least}""")
    f = "[" + ",".join(map(str, klogk(HEX.window))) + "]"
    allowed = " AND ".join(f"NOT contains(lower(v), '{a}')" for a in ALLOWED)
    w = HEX.window
    name = "['assign','access','hex','entropy'][k] || ':' || s || ':' || e"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
found AS ({' UNION ALL '.join(parts)}),
spans AS (SELECT doc_id, k, v, s, s + length(m) AS e FROM found),
cand AS (SELECT DISTINCT v FROM spans WHERE k = 4 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND {allowed}),
win AS (SELECT v, i, substr(v, i, {w}) AS x FROM (SELECT v, unnest(range(1, length(v) - {w} + 2)) AS i FROM cand)),
chars AS (SELECT v, i, c, count(*) AS n FROM (SELECT v, i, unnest(string_split(x, '')) AS c FROM win) GROUP BY v, i, c),
tense AS (SELECT v, min(s) AS s FROM (SELECT v, i, sum({f}[n + 1]) AS s FROM chars GROUP BY v, i) GROUP BY v),
secret AS (SELECT v FROM tense WHERE s <= CASE WHEN regexp_full_match(v, '[0-9a-fA-F]+') THEN {HEX.most} ELSE {BASE64.most} END),
kept AS (SELECT doc_id, k, s, e FROM spans WHERE k < 4 UNION ALL
  SELECT doc_id, k, s, e FROM spans a WHERE k = 4 AND v IN (SELECT v FROM secret)
  AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.k < 4 AND b.doc_id = a.doc_id AND b.s <= a.s AND b.e >= a.e)),
per AS (SELECT doc_id, count(*) FILTER (k = 1) AS n_assign, count(*) FILTER (k = 2) AS n_access, count(*) FILTER (k = 3) AS n_hex, count(*) FILTER (k = 4) AS n_entropy,
  coalesce(string_agg({name}, ',' ORDER BY s, k, e) FILTER (k < 4), '') AS base, string_agg({name}, ',' ORDER BY s, k, e) AS spans FROM kept GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)
"""


ORACLE = _oracle()
