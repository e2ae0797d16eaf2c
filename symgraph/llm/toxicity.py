"""Operator 6: toxicity by fuzzy lexicon terms and their context.

The lexicon (whole words, and stems that many different words begin with) is learned from labelled rows. Its trie is
intersected with Levenshtein automata: one deterministic automaton, made as far as texts walk it, tells which term a word
is or misspells. Each hit is weighed by its context window: hits inside quotation marks or near words of reporting count
less, hits near another hit or an address in the second person count more. A logistic curve over the weights is fitted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from symgraph.llm.common import materialize, slices

#: Labelled rows that the lexicon and the curve are fitted on, about (rows are taken by a hash of their id).
FIT_ROWS = 20_000
#: Toxic rows that a term must have, however many there are.
LEAST = 3
#: A term enters if chance alone would tie it to the label so closely with this probability at most.
CHANCE = 1e-3
#: Log odds, as a share of the least that any needed term has, from which a term that isn't needed is kept too.
KEEN = 0.85
STEM = range(3, 9)
#: Words to each side that are a hit's context.
CONTEXT = 8
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_QUOTES = re.compile(r"[\"“”„«»]")
#: Words that report or speak about a term, and words that address someone (fixed values, four languages).
REPORTING = frozenset("said says wrote quoted called word term phrase slur title sagte schrieb zitat wort begriff dit écrit mot terme dijo escribió palabra término".split())
ADDRESS = frozenset("you your you're are du dein ihr sie bist tu toi vous votre es tú tu eres usted".split())
#: What a hit in quotation, near reporting, and near an address or another hit counts, as long as CONTEXT_HITS labelled hits don't tell.
FACTORS = (0.3, 0.6, 1.2)
CONTEXT_HITS, FACTOR_RANGE, MISSPELLED = 30, (0.1, 1.5), 0.7


#: Before a context's number among the counts of terms; no term has it.
CONTEXT_MARK = "#"


class FuzzyTrie:
    """Lexicon trie intersected with Levenshtein automata. find(word): (term, errors) of the nearest term, or None.

    A whole word of five letters or more may have one error, of nine or more two; shorter ones and stems none. A state is
    the set of trie nodes with the fewest errors at each; states and their moves are made when first needed and kept.
    """

    def __init__(self, terms: dict[str, bool]):
        self.terms = sorted(terms)
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stem = [terms[t] for t in self.terms]
        self.slack = [0]  # errors that a term below may have
        for i, term in enumerate(self.terms):
            node, errors = 0, 0 if terms[term] else (len(term) >= 5) + (len(term) >= 9)
            self.slack[0] = max(self.slack[0], errors)
            for c in term:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({}), self.ends.append(-1), self.slack.append(0)
                node = self.next[node][c]
                self.slack[node] = max(self.slack[node], errors)
            self.ends[node] = i
        self.states: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.results: list[tuple[int, int] | None] = []
        self.stems: list[int] = []
        self.start = self._state({0: 0})

    def _allowed(self, i: int) -> int:
        return 0 if self.stem[i] else (len(self.terms[i]) >= 5) + (len(self.terms[i]) >= 9)

    def _state(self, at: dict[int, int]) -> int:
        todo = list(at)
        while todo:  # letters of a term left out in the word
            node = todo.pop()
            for child in self.next[node].values():
                if at[node] + 1 <= self.slack[child] and at[node] + 1 < at.get(child, 9):
                    at[child] = at[node] + 1
                    todo.append(child)
        key = frozenset(at.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hits = [(e, self.ends[n]) for n, e in key if self.ends[n] >= 0 and e <= self._allowed(self.ends[n])]
            self.results.append(min(hits)[::-1] if hits else None)
            self.stems.append(next((i for e, i in sorted(hits) if self.stem[i]), -1))
        return self.states[key]

    def _move(self, state: int, c: str) -> int:
        at: dict[int, int] = {}
        for node, e in self.sets[state]:
            for letter, child in self.next[node].items():
                cost = e + (letter != c)
                if cost <= self.slack[child] and cost < at.get(child, 9):
                    at[child] = cost
            if e + 1 <= self.slack[node] and e + 1 < at.get(node, 9):  # a letter too many in the word
                at[node] = e + 1
        to = self._state(at) if at else -1
        if len(self.moves) < 200_000:
            self.moves[state][c] = to
        return to

    def find(self, word: str) -> tuple[str, int] | None:
        state, stem = self.start, -1
        for c in word:
            to = self.moves[state].get(c)
            state = self._move(state, c) if to is None else to
            if state < 0:
                return (self.terms[stem], 0) if stem >= 0 else None
            if self.stems[state] >= 0:
                stem = self.stems[state]
        if (hit := self.results[state]) and (hit[1] == 0 or stem < 0):
            return self.terms[hit[0]], hit[1]
        return (self.terms[stem], 0) if stem >= 0 else None


@dataclass
class Model:
    """weights: log odds of each term; misspelled: what a misspelling of it counts; curve: intercept and slope of the logistic curve over a text's summed weight; factors: see FACTORS."""

    weights: dict[str, float] = field(default_factory=dict)
    misspelled: dict[str, float] = field(default_factory=dict)
    stems: frozenset[str] = frozenset()
    curve: tuple[float, float] = (-2.0, 0.0)
    factors: tuple[float, float, float] = FACTORS

    def key(self) -> tuple:
        return tuple((t, w, self.misspelled.get(t, MISSPELLED * w)) for t, w in sorted(self.weights.items())), self.stems, self.curve, self.factors


@lru_cache(maxsize=2)
def _matcher(key: tuple) -> tuple[FuzzyTrie, dict[str, tuple[float, float]], dict[str, tuple[str, int] | None]]:
    weights, stems, *_ = key
    return FuzzyTrie({t: t in stems for t, _, _ in weights}), {t: (w, m) for t, w, m in weights}, {}


def find_hits(text: str, key: tuple) -> list[tuple[int, str, int, tuple[bool, bool, bool]]]:
    """(word number, term, errors, context: in quotation, near reporting, near an address or another hit) of each hit. A word is a run of letters, lower-cased."""
    trie, _, known = _matcher(key)
    low = text.lower()
    words = _WORD.findall(low)
    if len(known) > 300_000:
        known.clear()
    different = set(words)
    for w in different:
        if w not in known:
            known[w] = trie.find(w)
    found = {w: hit for w in different if (hit := known[w])}
    if not found:
        return []
    hits = [(i, *found[w]) for i, w in enumerate(words) if w in found]
    marks = np.array([m.start() for m in _QUOTES.finditer(low)], np.int64)
    if len(marks):
        places = np.fromiter((m.start() for m in _WORD.finditer(low)), np.int64, len(words))
        mark_word = np.searchsorted(places, marks)  # words before each mark
    at = {i for i, *_ in hits}
    out = []
    for i, term, errors in hits:
        near = words[max(0, i - CONTEXT) : i] + words[i + 1 : i + 1 + CONTEXT]
        quoted = False
        if len(marks):  # an odd number of marks before it, and few words between the last of them and the next
            before = int(np.searchsorted(marks, places[i]))
            quoted = before % 2 == 1 and before < len(marks) and mark_word[before] - mark_word[before - 1] <= 3 * CONTEXT
        addressed = not ADDRESS.isdisjoint(near) or any(j in at for j in range(i - CONTEXT, i + CONTEXT + 1) if j != i)
        out.append((i, term, errors, (bool(quoted), not REPORTING.isdisjoint(near), addressed)))
    return out


def total_weight(text: str, key: tuple) -> float:
    """Weight of the strongest hit of each term, summed and damped. Texts without a hit have 0."""
    _, weights, _ = _matcher(key)
    best: dict[str, float] = {}
    for _, term, errors, context in find_hits(text, key):
        w = weights[term][errors > 0]
        for is_so, factor in zip(context, key[3]):
            w *= factor if is_so else 1.0
        best[term] = max(best.get(term, 0.0), w)
    return log(1 + sum(best.values()))


def fit_factors(counts: dict[tuple[int, int], int], n1: int, n0: int) -> tuple[float, float, float]:
    """What each context makes of a hit's log odds. counts: hits by (context, label), context 0 to 2 as in FACTORS and 3 for hits in none.

    A factor is the log odds of a toxic row among hits in the context, as a share of those of hits in none, within
    FACTOR_RANGE; with fewer than CONTEXT_HITS hits in the context or in none, the one of FACTORS.
    """
    odds = lambda c: log((counts.get((c, 1), 0) + 0.5) / n1) - log((counts.get((c, 0), 0) + 0.5) / n0)
    some = lambda c: counts.get((c, 1), 0) + counts.get((c, 0), 0) >= CONTEXT_HITS
    plain = odds(3)
    out = [min(FACTOR_RANGE[1], max(FACTOR_RANGE[0], odds(c) / plain)) if some(c) and some(3) and plain > 0 else FACTORS[c] for c in range(3)]
    return (out[0], out[1], out[2])


def score_text(text: str, key: tuple) -> float:
    a, b = key[2]
    return 1 / (1 + exp(-max(-30.0, min(30.0, a + b * total_weight(text, key)))))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, stem, toxic documents, other documents) of a task's rows."""
    toxic: Counter = Counter()
    clean: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
            words = set(_WORD.findall((text or "").lower()))
            (toxic if label else clean).update([*words, *{w[:n] + "*" for w in words for n in STEM if len(w) > n}])
    for at in range(0, len(names := sorted(toxic)), 50_000):  # terms without a toxic document can't enter
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([toxic[t] for t in part], pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "n1", "n0"])
    for at in range(0, len(names := sorted(clean.keys() - toxic.keys())), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([0] * len(part), pa.int64()), pa.array([clean[t] for t in part], pa.int64())], names=["term", "n1", "n0"])


def telling(a: int, b: int, n1: int, n0: int) -> tuple[float, float]:
    """Of a term in a of n1 toxic rows and b of n0 others: its log odds less two standard errors, and the log of the probability that of its rows a or more were toxic by chance."""
    w = log((a + 0.5) / (n1 + 1)) - log((b + 0.5) / (n0 + 1)) - 2 * (1 / (a + 0.5)) ** 0.5
    n, q = a + b, n1 / (n1 + n0)
    if q == 1:
        return w, 0.0
    first = lgamma(n + 1) - lgamma(a + 1) - lgamma(b + 1) + a * log(q) + b * log(1 - q)
    total = part = 1.0
    for k in range(a + 1, n + 1):
        part *= (n - k + 1) / k * q / (1 - q)
        total += part
        if part < 1e-12 * total:
            break
    return w, first + log(total)


def choose_terms(rows: Iterable[tuple[str, int, int]], n1: int, n0: int) -> tuple[dict[str, float], frozenset[str]]:
    """Terms (a stem ends in *) whose log odds are high beyond chance. A stem enters only if it reaches far more documents than any word below it and than longer stems."""
    odds = {}
    for term, a, b in rows:
        w, chance = telling(a, b, n1, n0)
        if a >= LEAST and w > 1 and chance <= log(CHANCE):
            odds[term] = (w, a, b)
    words = {t: x for t, x in odds.items() if t[-1] != "*"}
    most: dict[str, int] = {}
    for t, (_, a, _) in words.items():
        for n in STEM:
            most[t[:n]] = max(most.get(t[:n], 0), a)
    stems = {t[:-1]: x for t, x in odds.items() if t[-1] == "*" and x[1] >= 2 * most.get(t[:-1], 0) and x[2] <= 0.1 * x[1]}
    within = {o[:n] for o, y in stems.items() for n in range(1, len(o)) if (x := stems.get(o[:n])) and y[1] >= 0.98 * x[1] and y[2] <= x[2]}
    longest = stems.keys() - within
    shortest = {s: stems[s] for s in longest if not any(s[:n] in longest for n in range(1, len(s)))}
    kept = {t: x for t, x in words.items() if not any(t[:n] in shortest for n in range(1, len(t) + 1))} | shortest
    return {t: kept[t][0] for t in sorted(kept)}, frozenset(shortest)


def exact_terms(text: str, weights: dict[str, float], stems: frozenset[str]) -> set[str]:
    """Terms that words of the text are, or begin with, without errors."""
    words = set(_WORD.findall(text.lower()))
    return {w for w in words if w in weights and w not in stems} | {w[:n] for w in words for n in STEM if w[:n] in stems}


def cover(rows: list[tuple[Iterable[str], int]], weights: dict[str, float]) -> dict[str, float]:
    """Of these terms those that explain toxic rows, the most significant first, and those with about as high odds.

    rows: (terms met, label). Each term must be telling among the rows that no term before it reaches, by the same
    measure and the same fixed count as in choose_terms: words that only stand beside a term, in its rows or in copies
    of them, aren't.
    """
    met = [(set(terms) & weights.keys(), y) for terms, y in rows]
    having: dict[str, list[int]] = {}
    for i, (terms, _) in enumerate(met):
        for t in terms:
            having.setdefault(t, []).append(i)
    left = Counter(y for _, y in met)
    count = {y: Counter(t for terms, label in met if label == y for t in terms) for y in (0, 1)}
    chosen: dict[str, float] = {}
    gone: set[int] = set()
    while True:
        best = None
        for t, a in count[1].items():
            if a >= LEAST:
                w, chance = telling(a, count[0][t], left[1], left[0])
                if w > 1 and chance <= log(CHANCE) and (best is None or (chance, t) < best):
                    best = (chance, t)
        if best is None:
            break
        chosen[best[1]] = weights[best[1]]
        for i in having[best[1]]:
            if i not in gone:
                gone.add(i)
                terms, y = met[i]
                left[y] -= 1
                count[y].subtract(terms)
    keen = KEEN * min(chosen.values(), default=0.0)
    return chosen | {t: w for t, w in weights.items() if chosen and w >= keen}


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression on one feature, by Newton's steps; a small ridge and two pseudo-rows keep it finite."""
    x, y = np.append(x, [0.0, x.max() if len(x) else 1.0]), np.append(y, [0.0, 1.0])
    m, w = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        w += np.linalg.solve((m * (p * (1 - p))[:, None]).T @ m + 1e-2 * np.eye(2), m.T @ (y - p) - 1e-2 * w)
    return float(w[0]), float(max(w[1], 0.0))


def held_out(doc_id):
    """True for the fifth of ids that nothing may be learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learn from labelled rows that aren't held out, about fit_rows of them. Null labels and ids are passed over; without rows of both kinds the model finds nothing."""
    known = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out(F.col("id")))
    total = known.count()
    if total > fit_rows:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / total))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    picked = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("text")).join(F.broadcast(known), "id").select("text", "toxic")  # of about fit_rows rows, 16 bytes each
    picked = materialize(picked, "labelled")
    n = dict(picked.groupBy("toxic").count().collect())
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model()
    counts = picked.mapInArrow(_term_counts, "term string, n1 long, n0 long").groupBy("term").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # what choose_terms could take: all terms whose odds stand out, of the words of about fit_rows rows
    likely = counts.where(f"n1 >= {LEAST} and ln((n1 + 0.5) / {n1 + 1}) - ln((n0 + 0.5) / {n0 + 1}) - 2 / sqrt(n1 + 0.5) > 0.999")
    weights, stems = choose_terms([tuple(r) for r in likely.collect()], n1, n0)
    names = sorted(weights)
    number = {t: i for i, t in enumerate(names)}

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [sorted(number[t] for t in exact_terms(x or "", weights, stems)) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), batch.column("toxic").cast(pa.int32())], names=["terms", "y"])

    met = picked.mapInArrow(meet, "terms array<int>, y int").collect()  # term numbers for each of about fit_rows rows
    weights = cover([([names[i] for i in r.terms], r.y) for r in met], weights)
    stems = frozenset(stems & weights.keys())
    first = Model(weights, {}, stems).key()

    def misspell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for text, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                hits = find_hits(text or "", first)
                seen.update((t, y) for t in {h[1] for h in hits if h[2]} - {h[1] for h in hits if not h[2]})
                contexts = {c for h in hits for c in range(4) if (h[3][c] if c < 3 else not any(h[3]))}  # once for a row, whatever its length
                seen.update((f"{CONTEXT_MARK}{c}", y) for c in contexts)
            terms, labels = [t for t, _ in seen], [y for _, y in seen]
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(labels, pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["term", "y", "n"])

    seen = {(r.term, r.y): r.n for r in picked.mapInArrow(misspell, "term string, y int, n long").groupBy("term", "y").agg(F.sum("n").alias("n")).collect()}
    # a misspelling counts less the more clean rows have it
    misspelled = {t: MISSPELLED * w * (seen.get((t, 1), 0) + 2) / (seen.get((t, 1), 0) + seen.get((t, 0), 0) + 2) for t, w in weights.items()}
    factors = fit_factors({(int(t[1:]), y): n for (t, y), n in seen.items() if t.startswith(CONTEXT_MARK)}, n1, n0)
    choices = sorted({FACTORS, factors})
    keys = [Model(weights, misspelled, stems, factors=f).key() for f in choices]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([[total_weight(t or "", k) for k in keys] for t in batch.column("text").to_pylist()], pa.list_(pa.float64())), batch.column("toxic").cast(pa.int32())], names=["x", "y"])

    pairs = picked.mapInArrow(weigh, "x array<double>, y int").collect()  # three numbers for each of about fit_rows rows
    xs, y = np.array([r.x for r in pairs]), np.array([r.y for r in pairs], float)
    fits = []
    for i, f in enumerate(choices):  # the factors under which the curve fits the labels better
        order = np.lexsort((y, xs[:, i]))
        curve = fit_curve(xs[order, i], y[order])
        p = 1 / (1 + np.exp(-np.clip(curve[0] + curve[1] * xs[order, i], -30, 30)))
        fits.append((float(-np.log(np.where(y[order] == 1, p, 1 - p)).mean()), f, curve))
    _, factors, curve = min(fits)
    return Model(weights, misspelled, stems, curve, factors)


def score(docs: DataFrame, model: Model, text_col: str = "text", into: str = "score") -> DataFrame:
    """docs with one more column, a score from 0 to 1. Null and empty texts have the score of a text without hits. Rows, repeated ones too, keep their other columns."""
    key, at = model.key(), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            scores = pa.array([score_text(t or "", key) for t in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, into])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(into, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted (1 if the score is 0.5 or more). A null doc_id isn't held out."""
    model = fit(docs, labels, fit_rows)
    scored = score(docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")), model).select("doc_id", "score")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without the rows that score threshold or more."""
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return score(docs, fit(docs, labels), into=name).where(F.col(name) < threshold).drop(name)
