"""Toxicity: a Levenshtein automaton intersected with a lexicon trie, and scores of the context of each hit.

The lexicon is mined from labelled rows: whole words and word stems that stand in toxic texts and hardly
elsewhere. Its trie and the automata that accept a term within its edit distance are multiplied into one
deterministic table, which reads each token once and dies early on most. Around a hit a window is scored for
signs of quotation (quote marks, words of reporting) and of address; a logistic model weighs the hits.
"""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import crc_mod, lean, materialise, seeded_rows, table

#: Documented bound of the fitting sample: rows of either label. Their whole texts are read where they lie.
SAMPLE_ROWS = 3_000
#: Least texts that hold a term of the lexicon; least share of toxic ones among those (at equal numbers of both), with so
#: many further texts of the other kind taken as seen. Every term that passes is taken.
LEAST_TEXTS, PRECISION, DOUBT = 4, 0.95, 2
#: A stem yields to a word of its own that has this share of its texts.
ONE_WORD = 0.7
STEM_SIZES = range(4, 9)
#: Characters on either side of a hit that make up its context.
WINDOW = 80
QUOTES, APOSTROPHES = "\"“”„«»‘`", "'’"
REPORTING = ("said", "says", "called", "word", "quote", "quoted", "term", "means", "wrote", "insult", "slur")
ADDRESS = ("you", "your", "youre", "u", "ur", "tu", "du", "te", "sie", "vous", "usted")
AT_ONCE = 2_000_000


def edits(term: str, stem: bool) -> int:
    """Edits (a letter more, less or other, or two neighbours swapped) within which a term still counts."""
    n = len(term)
    return 0 if stem or n < 4 else 1 if n < 12 else 2


@lru_cache(maxsize=1)
def fold() -> np.ndarray:
    """Code point -> lower case of letters and digits; anything else is a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        x = chr(c)
        if x.isalnum():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Automaton:
    """The product of the lexicon trie and the Levenshtein automata of its terms, made deterministic.

    A state is a set of (trie node, letter awaited after the second of two swapped ones or 0, edits used). State 0 is
    dead, state 1 the start. ``now`` holds for a state the stem it has accepted (any ending may follow), ``end`` the word it
    accepts if the token ends there, both as 1 + term * 4 + edits, and 0 for none.
    """

    def __init__(self, terms: list[tuple[str, bool]]) -> None:
        self.terms = terms
        letters = sorted({c for t, _ in terms for c in t})
        self.code = {c: i + 1 for i, c in enumerate(letters)}  # 0: any other character
        self.classes = len(letters) + 1
        kids: list[dict[int, int]] = [{}]
        done: list[list[tuple[int, bool, int]]] = [[]]
        most = [0]
        for n, (t, stem) in enumerate(terms):
            at, k = 0, edits(t, stem)
            most[0] = max(most[0], k)
            for c in t:
                nxt = kids[at].get(self.code[c])
                if nxt is None:
                    nxt = kids[at][self.code[c]] = len(kids)
                    kids.append({})
                    done.append([])
                    most.append(0)
                at = nxt
                most[at] = max(most[at], k)
            done[at].append((n, stem, k))

        def closed(pairs: dict[tuple[int, int], int]) -> frozenset:
            """With skipped letters of the term; only the fewest edits of each node."""
            todo = list(pairs.items())
            while todo:
                (node, due), e = todo.pop()
                for kid in kids[node].values() if not due else ():
                    if e + 1 <= most[kid] and pairs.get((kid, 0), 9) > e + 1:
                        pairs[kid, 0] = e + 1
                        todo.append(((kid, 0), e + 1))
            return frozenset(pairs.items())

        def step(state: frozenset, c: int) -> frozenset:
            out: dict[tuple[int, int], int] = {}

            def put(node: int, e: int, due: int = 0) -> None:
                if e <= most[node] and out.get((node, due), 9) > e:
                    out[node, due] = e

            for (node, due), e in state:
                if due:  # the first letter of a swapped pair has been read second
                    if due == c:
                        put(node, e)
                    continue
                put(node, e + 1)  # a letter too many
                for letter, kid in kids[node].items():
                    put(kid, e if letter == c else e + 1)
                    if letter != c and c in kids[kid]:
                        put(kids[kid][c], e + 1, letter)
            return closed(out)

        def best(state: frozenset, stem: bool) -> int:
            found = [(e, n) for (node, due), e in state if not due for n, s, k in done[node] if s == stem and e <= k]
            return 1 + min(found)[1] * 4 + min(found)[0] if found else 0

        first = closed({(0, 0): 0}) if terms else frozenset()
        states, rows = {frozenset(): 0, first: 1}, [[0] * self.classes]
        todo = deque([first])
        self.now, self.end = [0], [0]
        while todo:
            s = todo.popleft()
            self.now.append(best(s, True))
            self.end.append(best(s, False))
            row = []
            for c in range(self.classes):
                if self.now[-1] and (self.now[-1] - 1) % 4 == 0:  # an exact stem: nothing further can be better
                    row.append(0)
                    continue
                nxt = step(s, c)
                if nxt not in states:
                    states[nxt] = len(states)
                    todo.append(nxt)
                row.append(states[nxt])
            rows.append(row)
        self.table = np.array(rows, np.int32)
        self.now, self.end = np.array(self.now, np.int32), np.array(self.end, np.int32)
        self.lut = np.zeros(0x110000, np.uint8)
        for c, i in self.code.items():
            self.lut[ord(c)] = i

    def match(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of tokens x[start : start + size]: which ones are hits, and their 1 + term * 4 + edits."""
        if not self.terms:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        live, state, found = np.arange(len(starts)), np.ones(len(starts), np.int32), np.zeros(len(starts), np.int32)
        k = 0
        while len(live):
            over = sizes[live] == k
            ended = live[over]
            found[ended] = np.where(found[ended] > 0, found[ended], self.end[state[over]])
            live, state = live[~over], state[~over]
            state = self.table[state, self.lut[x[starts[live] + k]]]
            hit, had = self.now[state], found[live]
            better = (hit > 0) & ((had == 0) | ((hit - 1) % 4 < (had - 1) % 4))
            found[live[better]] = hit[better]
            stay = state > 0
            live, state = live[stay], state[stay]
            k += 1
        at = np.flatnonzero(found)
        return at, found[at]


@dataclass
class Model:
    auto: Automaton
    gain: np.ndarray  # log odds of each term
    spared: frozenset[str]  # words near a term that clean texts use
    firm: frozenset[int]  # terms near which clean texts go on using words that were not seen before
    weights: np.ndarray
    bias: float


FEATURES = 8


def quotes(text: str, at: int) -> bool:
    """Whether the character is a quote mark; an apostrophe between two letters is none."""
    c = text[at]
    if c in QUOTES:
        return True
    return c in APOSTROPHES and not (0 < at < len(text) - 1 and text[at - 1].isalnum() and text[at + 1].isalnum())


def features(texts: list[str], auto: Automaton, gain: np.ndarray, spared: frozenset[str] = frozenset(), firm: frozenset[int] = frozenset()) -> np.ndarray:
    """(texts, FEATURES): hits that are direct and quoted, sure and doubtful; of the sure ones the odds of direct terms, those
    with words of address nearby, different terms, and how many there are in 100 words. A hit within edits is doubtful if its term is
    ``firm``, and none if its word is ``spared``."""
    joined, lut = "".join(t + "\n" for t in texts), fold()
    x = lut[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")]
    word = np.concatenate([[False], x != 32, [False]])
    flank = np.diff(word.astype(np.int8))
    starts, ends = np.flatnonzero(flank == 1), np.flatnonzero(flank == -1)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    tokens = np.diff(np.searchsorted(starts, bounds))
    out = np.zeros((len(texts), FEATURES))
    at, code = auto.match(x, starts, ends - starts)
    terms: dict[int, set[int]] = {}
    for token, c in zip(at.tolist(), code.tolist()):
        s, e = int(starts[token]), int(ends[token])
        term, off = (c - 1) // 4, (c - 1) % 4
        if off and joined[s:e].lower() in spared:
            continue
        off = off > 0 and term in firm
        doc = int(np.searchsorted(bounds, s, "right")) - 1
        low, high = max(int(bounds[doc]), s - WINDOW), min(int(bounds[doc + 1]) - 1, e + WINDOW)
        near = ("".join(ch if ch.isalnum() else " " for ch in joined[low:s] + " " + joined[e:high])).lower().split()
        marks = [k for k in range(low, high) if not s <= k < e and quotes(joined, k)]
        quoted = sum(k < s for k in marks) % 2 == 1 and any(k >= e for k in marks) or any(w in REPORTING for w in near)
        out[doc, (2 if off else 0) + (1 if quoted else 0)] += 1
        if not off:
            out[doc, 4] += 0.0 if quoted else max(0.0, float(gain[term]))
            out[doc, 5] += any(w in ADDRESS for w in near)
            terms.setdefault(doc, set()).add(term)
    for doc, some in terms.items():
        out[doc, 6] = len(some)
    out[:, 7] = 100 * out[:, :2].sum(axis=1) / np.maximum(1, tokens)
    return np.log1p(out)


def in_groups(texts: list) -> Iterator[list[str]]:
    group, n = [], 0
    for t in texts:
        if group and n + len(t or "") > AT_ONCE:
            yield group
            group, n = [], 0
        group.append(t or "")
        n += len(t or "")
    if group:
        yield group


def words_of(text: str) -> set[str]:
    return set("".join(c if c.isalnum() else " " for c in text.lower()).split())


def mine(rows: DataFrame) -> tuple[list[tuple[str, bool]], np.ndarray]:
    """The lexicon: (term, is a stem) and the log odds of each, from the words of whole texts, counted by tasks."""

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                some = set()
                for w in words_of(t):
                    if 3 <= len(w) <= 24 and not w.isdigit():
                        some.add((w, False))
                        some.update((w[:k], True) for k in STEM_SIZES if len(w) >= k)
                counts[int(y)].update(some)
        keys = list({**counts[0], **counts[1]})
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()), *[pa.array([counts[y][k] for k in keys], pa.int64()) for y in (0, 1)]], ["term", "stem", "c0", "c1"])

    n = {int(r["toxic"]): r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return [], np.zeros(0)
    found = rows.select("text", "toxic").mapInArrow(lean(scan), "term string, stem boolean, c0 long, c1 long").groupBy("term", "stem").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    r1, r0 = F.col("c1") / n1, (F.col("c0") + DOUBT) / n0
    found = found.where((F.col("c1") >= LEAST_TEXTS) & (r1 / (r1 + r0) >= PRECISION)).collect()  # words of a bounded sample
    good = {(r["term"], r["stem"]): (r["c1"], math.log((r["c1"] + 0.5) / (n1 + 1)) - math.log((r["c0"] + 0.5) / (n0 + 1))) for r in found}
    stems = [k for k in good if k[1] and not any((k[0][:j], True) in good for j in range(STEM_SIZES[0], len(k[0])))]
    words = [k for k in good if not k[1]]
    stems = [k for k in stems if not any(w[0].startswith(k[0]) and good[w][0] >= ONE_WORD * good[k][0] for w in words)]
    rank = lambda keys: sorted(keys, key=lambda k: (-good[k][0], k[0]))
    terms = rank(stems) + rank(words)
    return terms, np.array([good[k][1] for k in terms])


def spare(rows: DataFrame, auto: Automaton) -> tuple[list[frozenset[str]], frozenset[int]]:
    """Words within edits of a term that stand in texts labelled clean, and so are no misspellings: those of either half of
    the rows. And the terms near which one half has words that the other does not spare."""
    shared = rows.sparkSession.sparkContext.broadcast(auto)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: set[tuple[int, str, int]] = set()
        for batch in batches:
            for half in (0, 1):
                for group in in_groups(batch.column("text").filter(pa.array(batch.column("h").to_numpy() % 2 == half)).to_pylist()):
                    words = sorted({w for t in group for w in words_of(t)})
                    if not words:
                        continue
                    x = fold()[np.frombuffer("\n".join([*words, ""]).encode("utf-32-le", "surrogatepass"), "<u4")]
                    starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in words])[:-1]]).astype(int)
                    at, code = shared.value.match(x, starts, np.array([len(w) for w in words], int))
                    out.update((half, words[k], int(c - 1) // 4) for k, c in zip(at, code) if (c - 1) % 4)
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in sorted(out)], kind) for k, kind in enumerate((pa.int32(), pa.string(), pa.int32()))], ["half", "word", "term"])

    if not auto.terms:
        return [frozenset(), frozenset()], frozenset()
    found = rows.where("toxic = 0").select("h", "text").mapInArrow(lean(scan), "half int, word string, term int").distinct().collect()  # words of a bounded sample
    halves = [frozenset(r["word"] for r in found if r["half"] == k) for k in (0, 1)]
    return halves, frozenset(r["term"] for r in found if r["word"] not in halves[1 - r["half"]])


def weigh(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic weights of the features, both labels weighing the same."""
    w, b = np.zeros(FEATURES), 0.0
    share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for _ in range(600):  # Newton steps would do too; this is small and steady
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = share * (p - y)
        w -= 2.0 * (x.T @ g + 1e-4 * w)
        b -= 2.0 * g.sum()
    return w, b


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """h, toxic, text of at most SAMPLE_ROWS ids of either label outside the held-out fold, by a seeded order of their ids; an
    id that repeats counts with each of its texts, and equal texts of one label count once, so that what a text that was copied
    often happens to hold is no lexicon. A written table."""
    rows = labels.where(F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), 5) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("__tg_id")).agg(F.max("toxic").alias("toxic")).withColumn("h", F.xxhash64(F.lit(10), "__tg_id"))
    some = [seeded_rows(rows.where(F.col("toxic") == y), SAMPLE_ROWS, "__tg_id") for y in (0, 1)]
    side = F.broadcast(some[0].union(some[1]))  # 2 * SAMPLE_ROWS rows at most
    narrow = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = narrow.join(side, F.col("doc_id") == F.col("__tg_id")).select("h", "toxic", "text")
    return materialise(joined.groupBy("toxic", "text").agg(F.min("h").alias("h")).select("h", "toxic", "text"), "toxicity-rows")


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Mine the lexicon and fit the weights of its hits. Texts stay where they are; words of the lexicon and FEATURES numbers for
    each row of the sample go to the driver."""
    rows = training_rows(docs, labels)
    terms, gain = mine(rows)
    auto = Automaton(terms)
    if not terms:
        return Model(auto, gain, frozenset(), frozenset(), np.zeros(FEATURES), -20.0)
    halves, firm = spare(rows, auto)
    shared = rows.sparkSession.sparkContext.broadcast((auto, gain, halves, firm))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, gain, halves, firm = shared.value
        for batch in batches:
            for half in (0, 1):  # weights are learned from rows that had no part in what is spared
                mine = batch.filter(pa.array(batch.column("h").to_numpy() % 2 == half))
                if mine.num_rows:
                    x = np.concatenate([features(g, auto, gain, halves[1 - half], firm) for g in in_groups(mine.column("text").to_pylist())])
                    yield pa.RecordBatch.from_arrays([mine.column("h"), mine.column("toxic").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["h", "toxic", "x"])

    seen = sorted((r["h"], r["x"], r["toxic"]) for r in rows.mapInArrow(lean(scan), "h long, toxic int, x array<double>").collect())
    return Model(auto, gain, halves[0] | halves[1], firm, *weigh(np.array([r[1] for r in seen]), np.array([r[2] for r in seen], float)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row, over its whole text.

    A null or empty text has no hits and gets the score of a text without any. Without labels of both kinds every
    score is near 0. Only the text is an input of a score; other columns are ignored; an empty table gives an
    empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            x = np.concatenate([features(g, m.auto, m.gain, m.spared, m.firm) for g in in_groups(batch.column("text").to_pylist())] or [np.zeros((0, FEATURES))])
            p = 1 / (1 + np.exp(-(x @ m.weights + m.bias)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    return rows.mapInArrow(lean(scan), "doc_id long, held_out boolean, score double, predicted int")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
