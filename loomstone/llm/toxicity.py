"""Toxicity: a lexicon trie, read through Levenshtein automata, with scores from the words around a hit.

Learning. Words, and stems of words (prefixes), that mark toxic documents are counted over labelled
documents in Spark; the best become the lexicon. The matcher then runs over the same documents and a
weight is counted for each term at each edit distance, so that a term whose misspellings are ordinary
words elsewhere gets no weight for them.

Matching. States of the product of the trie and the automata are sets of (node, errors); they are made
as they are needed and kept, so a word costs one table lookup a character and most words leave the
table after a few. A word matches a term within the distance that its length allows, and a stem if
the word begins so; a stem comes before a term, so that all its forms are one.

Context. Each hit's weight is scaled by what stands around it: inside quotation marks, or near words
that report speech, it counts less; near an address of the reader it counts more.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstone.llm.common import cut, like, sampled, ship

#: Labelled documents to learn from, at most about (a hash of the id picks them); terms of the lexicon.
TRAIN_ROWS, TERMS = 40_000, 400
#: Lengths of stems; toxic documents that must have a term, as a share of all and at least.
STEMS, SUPPORT, LEAST = (4, 5, 6, 7), 0.01, 4
#: A term found in so many toxic documents has half of its weight: of many rare words, some are toxic by chance only.
DOUBT = 15
#: Words on either side of a hit that are its context, and the factors of what may stand there.
WINDOW, QUOTED, REPORTED, ADDRESSED = 6, 0.4, 0.7, 1.15
REPORTING = frozenset("said says wrote writes quoted quotes quote called term word slur phrase according reported sagte schrieb zitiert wort dit écrit cité mot dijo escribió citó palabra".split())
ADDRESSING = frozenset("you your youre ya u du dich dein ihr tu toi vous votre te tú usted ustedes".split())
_opening, _closing, _same = "“«„‹", "”»‟›", '"'

_word = re.compile(r"[^\W_]+")
_leet = str.maketrans("0134578@$!", "oieastbasi")


def allowed(length: int) -> int:
    """Edits that a term of this length may have."""
    return 0 if length < 5 else 1 if length < 9 else 2


class Matcher:
    """Longest and closest lexicon term of a word: (term number, distance), or None."""

    def __init__(self, terms: list[str], stems: list[str]):
        self.terms = [*terms, *[s + "*" for s in stems]]
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int | None] = [None]
        self.prefix: list[int | None] = [None]
        self.budget: list[int] = [0]  # most edits of any term below a node
        for i, t in enumerate(self.terms):
            stem = t.endswith("*")
            at, t = 0, t.rstrip("*")
            may = 0 if stem else allowed(len(t))
            self.budget[0] = max(self.budget[0], may)
            for ch in t:
                if ch not in self.next[at]:
                    self.next[at][ch] = len(self.next)
                    self.next.append({})
                    self.ends.append(None)
                    self.prefix.append(None)
                    self.budget.append(0)
                at = self.next[at][ch]
                self.budget[at] = max(self.budget[at], may)
            if stem:
                self.prefix[at] = i
            else:
                self.ends[at] = i
        self._reset()

    def _reset(self) -> None:
        self.states: list[dict[tuple[int, int], int]] = []
        self.moves: list[dict[str, int]] = []
        self.numbers: dict = {}
        self.start = self._number(self._closed({0: 0}))

    def _closed(self, nodes: dict[int, int]) -> dict[int, int]:
        """nodes with the fewest edits to reach them, and what is reached by leaving out letters of a term."""
        todo = list(nodes)
        while todo:
            at = todo.pop()
            for child in self.next[at].values():
                cost = nodes[at] + 1
                if cost <= self.budget[child] and cost < nodes.get(child, 99):
                    nodes[child] = cost
                    todo.append(child)
        return nodes

    def _number(self, nodes: dict[int, int]) -> int:
        key = frozenset(nodes.items())
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(nodes)
            self.moves.append({})
        return self.numbers[key]

    def _move(self, state: int, ch: str) -> int:
        out: dict[int, int] = {}

        def reach(node: int, cost: int) -> None:
            if cost <= self.budget[node] and cost < out.get(node, 99) or cost == 0:
                out[node] = min(cost, out.get(node, 99))

        for node, cost in self.states[state].items():
            for c, child in self.next[node].items():
                reach(child, cost if c == ch else cost + 1)
            reach(node, cost + 1)  # a letter too many
        self.moves[state][ch] = to = self._number(self._closed(out)) if out else -1
        return to

    def match(self, word: str) -> tuple[int, int] | None:
        if len(self.states) > 50_000:
            self._reset()
        state, stem, start = self.start, None, word[:1]
        for ch in word:
            to = self.moves[state].get(ch)
            state = self._move(state, ch) if to is None else to
            if state < 0:
                return stem
            for node, cost in self.states[state].items():
                if cost == 0 and self.prefix[node] is not None:
                    stem = (self.prefix[node], 0)
        # the first letter of a misspelled term stands
        best = None
        for node, cost in self.states[state].items():
            i = self.ends[node]
            if i is not None and (cost == 0 or cost <= allowed(len(self.terms[i])) and self.terms[i][0] == start):
                if best is None or (cost, i) < (best[1], best[0]):
                    best = (i, cost)
        return stem or best


@dataclass
class Model:
    terms: list[str]
    stems: list[str]
    weights: dict[tuple[int, int], float] = field(default_factory=dict)
    bias: float = -3.0

    def matcher(self) -> Matcher:
        return Matcher(self.terms, self.stems)


def _hits(chunk: str, matcher: Matcher) -> tuple[tuple[int, int], ...]:
    """Matches of a chunk between spaces: its words, or the whole chunk with letters for look-alike signs."""
    lower = chunk.lower()
    found = [m for w in _word.findall(lower) if (m := matcher.match(w))]
    if not found and (plain := lower.translate(_leet)) != lower:
        found = [m for w in _word.findall(plain) if not w.isdigit() and (m := matcher.match(w))]
    return tuple(found)


class Scorer:
    """Hits of texts, with their contexts; a bounded cache of chunks."""

    def __init__(self, model: Model):
        self.model, self.matcher, self.cache = model, model.matcher(), {}

    def hits(self, text: str) -> list[tuple[tuple[int, int], float]]:
        """Each hit of a text and the factor of its context."""
        chunks = text.split()
        cache = self.cache
        if len(cache) > 400_000:
            cache.clear()
        where = []
        for at, c in enumerate(chunks):
            h = cache.get(c, 0)
            if h == 0:
                h = _hits(c, self.matcher)
                if len(c) <= 64:
                    cache[c] = h
            if h:
                where.append((at, h))
        out = []
        for at, h in where:
            factor = self.context(chunks, at)
            out += [(m, factor) for m in h]
        return out

    @staticmethod
    def context(chunks: list[str], at: int) -> float:
        """Quotation or abuse, from the words around chunk number at."""
        before, after = chunks[max(0, at - WINDOW) : at], chunks[at + 1 : at + 1 + WINDOW]
        left, right = " ".join([*before, chunks[at]]), " ".join([chunks[at], *after])
        opened = any(left.rfind(o) > left.rfind(c) for o, c in zip(_opening, _closing, strict=True)) and any(c in right for c in _closing)
        straight = left.count(_same) % 2 == 1 and _same in right or chunks[at].count(_same) >= 2
        words = {w for c in [*before, *after] for w in _word.findall(c.lower())}
        factor = QUOTED if opened or straight else 1.0
        if words & REPORTING:
            factor *= REPORTED
        if words & ADDRESSING and factor == 1.0:
            factor *= ADDRESSED
        return factor

    def score(self, text: str | None) -> tuple[float, int]:
        """Probability of label 1 and the number of hits; the strongest context of each term counts, once."""
        best: dict[int, float] = {}
        found = self.hits(text or "")
        for m, factor in found:
            w = self.model.weights.get(m, 0.0) * factor
            best[m[0]] = max(best.get(m[0], 0.0), w)
        z = self.model.bias + sum(best.values())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), len(found)


def train(docs: DataFrame, labels: DataFrame, use: Column, rows: int = TRAIN_ROWS, most_terms: int | None = TERMS, id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model:
    """Learn from documents with a label where use holds: about rows of them at most, equal texts once.

    The lexicon has at most most_terms terms and stems, those that mark most toxic documents (None: all that qualify).
    Without labelled rows, or without a toxic one, the lexicon is empty and every score the bias. Rows with a null id, text or
    label teach nothing; of several labels of one id the greatest holds.
    """
    spark = docs.sparkSession
    ship(spark)
    known = labels.select(F.col(f"`{id}`").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    total = known.count()
    if total > rows:
        known = known.where(sampled("train", "id", rows, total))
    # at most about rows ids, so a broadcast: texts stay where they are, and only the sample is written
    own = docs.where(use).select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text")).where("text IS NOT NULL").join(F.broadcast(known), "id")
    own = cut(own.withColumn("h", F.xxhash64("text")))
    one = own.groupBy("h").agg(F.min("id").alias("id"), F.max("y").alias("y"))
    seen = one.groupBy("y").agg(F.count("*").alias("n")).collect()
    n = {r["y"]: r["n"] for r in seen}
    pos, neg = n.get(1, 0), n.get(0, 0)
    if not pos:
        return Model([], [])
    sample = own.join(F.broadcast(one.select("id", "h", F.col("y").alias("_y"))), ["id", "h"]).select("text", F.col("_y").alias("y"))
    least = max(LEAST, int(SUPPORT * pos))

    def terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per batch, in how many documents each word and stem stands."""
        from collections import Counter

        for b in batches:
            for at in range(0, len(b), 1000):
                part = b.iloc[at : at + 1000]
                found: dict[int, Counter] = {0: Counter(), 1: Counter()}
                for t, y in zip(part["text"], part["y"], strict=True):
                    words = {w for w in _word.findall(t.lower()) if len(w) <= 40 and not w.isdigit()}
                    found[y].update(words)
                    found[y].update({w[:k] + "*" for w in words for k in STEMS if len(w) >= k})
                every = set(found[0]) | set(found[1])
                yield pd.DataFrame({"term": list(every), "p": [found[1][t] for t in every], "n": [found[0][t] for t in every]})

    counted = sample.mapInPandas(terms, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    odds = F.log((F.col("p") + 0.5) / (pos + 1)) - F.log((F.col("n") + 0.5) / (neg + 1))
    # the best have many toxic documents and next to no others; a stem must add to the words that begin so
    good = counted.where((F.col("p") >= least) & (F.col("n") <= 0.05 * F.col("p"))).withColumn("s", F.col("p") * odds).orderBy(F.desc("s"), "term")
    good = (good if most_terms is None else good.limit(most_terms)).collect()
    p_of = {r["term"]: r["p"] for r in good}
    stems: list[str] = []
    for s in sorted((t[:-1] for t in p_of if t.endswith("*")), key=lambda s: (len(s), s)):
        longest = max((p for t, p in p_of.items() if not t.endswith("*") and t.startswith(s)), default=0)
        if p_of[s + "*"] > 1.2 * longest and not any(s.startswith(x) for x in stems):
            stems.append(s)
    # a term that begins with a stem stays: its misspellings may not
    model = Model([t for t in p_of if not t.endswith("*")], stems)
    bare = spark.sparkContext.broadcast(model)

    def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from loomstone.llm.toxicity import Scorer

        s = Scorer(bare.value)
        for b in batches:
            out = [(i, d, y) for t, y in zip(b["text"], b["y"], strict=True) for i, d in {m for m, _ in s.hits(t)}]
            yield pd.DataFrame(out, columns=["term", "d", "y"])

    table = sample.mapInPandas(matches, "term int, d int, y int").groupBy("term", "d").agg(F.sum("y").alias("p"), F.count("*").alias("a")).collect()  # TERMS x 3 rows at most
    weigh = lambda p, a: math.log((p + 0.5) / (pos + 1)) - math.log((a - p + 0.5) / (neg + 1))
    by_distance = {d: weigh(sum(r["p"] for r in table if r["d"] == d), sum(r["a"] for r in table if r["d"] == d)) for d in {r["d"] for r in table}}
    bare.destroy()
    for i in range(len(model.terms) + len(stems)):
        for d in (0, 1, 2):
            r = next((r for r in table if (r["term"], r["d"]) == (i, d)), None)
            # few matches say little of a misspelling: its distance as a whole says more
            w = weigh(r["p"], r["a"]) if r and r["a"] >= 5 else by_distance.get(d, 4.0 - d)
            p = r["p"] if r else 0
            model.weights[i, d] = min(8.0, w) * p / (p + DOUBT) if w > 1.5 else 0.0
    rate = pos / (pos + neg)
    model.bias = max(-4.0, min(-1.5, math.log(rate / (1 - rate)) if neg else -1.5)) - 0.5
    return model


_scorers: dict = {}


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, score, hits of each row, from its whole text.

    Null and empty texts have no hits and the score of the bias; texts may be of any length, none is
    cut. Rows keep their partition, repeated ones each give a row, columns other than id and text are ignored, an empty table gives none.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from loomstone.llm.toxicity import Scorer

        s = Scorer(shared.value)
        for b in batches:
            out = [s.score(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array([x for x, _ in out], np.float64)), pa.array([x for _, x in out], pa.int64())], ["doc_id", "score", "hits"])

    return like(docs, [id, text]).mapInArrow(run, f"doc_id {kind}, score double, hits long").withColumnRenamed("doc_id", id)


def rejected(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text", above: float = 0.5) -> Column:
    """Whether a text's score reaches above, as a column (a pandas UDF), for filters that keep whole rows.

    Null and empty texts are not rejected, as the bias is below any such limit; an empty table gives none.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def bad(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from loomstone.llm.toxicity import Scorer

        s = Scorer(shared.value)
        for t in texts:
            yield pd.Series([s.score(x)[0] >= above for x in t], dtype="bool")

    return bad(F.col(f"`{text}`"))
