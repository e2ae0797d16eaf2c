"""Operator 2: licence scan as an exact set-similarity join.

Templates and text blocks are sets of words; a block meets a template if it holds a given share of its words. All words
of the templates have one order, rarest first by how often the whole corpus has them, and both sides are sorted by it.
If a block holds `need` words of a template, the first word they share is among the template's first size - need + 1 and
among the block's first size - need + 1 (prefix filter, both sides), the block has at least `need` words (length filter),
and at each shared word of the prefixes what is shared so far and what either side has left make up `need` (positional
filter). What passes is counted exactly.

Blocks are windows that overlap by half. A template of up to half a window lies whole in one of them, so each template
has windows of a length that follows from its own. Documents stream past an index of the templates' prefixes, which goes
to every task; nothing of a document is shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.llm.common import WORD_TABLE, byte_texts, slices
from symgraph.llm.license_texts import NOTICES, TEXTS

#: Words of the shortest blocks.
BLOCK = 64
#: Share of a template's words that a block must hold.
CONTAINMENT = 0.8
#: Words that tell one licence or version from another: a block without one that the template has gives no label.
NAMING = frozenset("mit apache gnu general lesser mozilla nc noncommercial sa 2 3".split())
#: Phrases whose words must stand consecutively, and their labels (given by the contract).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
TEMPLATES = NOTICES + TEXTS


def words_of(text: str) -> list[str]:
    return text.encode().translate(WORD_TABLE).decode().split()


@dataclass(frozen=True)
class Spec:
    """A template: its words (distinct), how many of them a block must hold, its label, the naming words, the words of its blocks, and the phrase if its words must stand together."""

    words: frozenset[str]
    need: int
    label: str
    naming: frozenset[str]
    block: int
    phrase: tuple[str, ...] | None = None


def specs_of(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, naming: frozenset[str] = NAMING, block: int = BLOCK) -> list[Spec]:
    """All templates; a template of n words (repeats included) has blocks of the first power of two times `block` that is 2 n or more."""
    size = lambda n: block << max(0, (ceil(2 * n / block) - 1).bit_length())
    out = [Spec(frozenset(w := p.split()), len(set(w)), label, frozenset(), size(len(w)), tuple(w)) for p, label in phrases.items()]
    for label, text in templates:
        w = words_of(text)
        out.append(Spec(frozenset(w), ceil(round(containment * len(set(w)), 6)), label, naming & set(w), size(len(w))))
    return out


class Index:
    """Prefix index of the templates under a global order of words; see the module's docstring.

    `stats` counts pairs of block and template: "prefix" share a word of both prefixes, of these "short" fail the length
    filter and "placed" the positional one, "counted" are counted exactly, and "met" meet the threshold.
    """

    def __init__(self, specs: list[Spec], counts: dict[str, int]):
        self.specs = specs
        order = sorted(frozenset().union(*(s.words for s in specs)), key=lambda w: (counts.get(w, 0), w)) if specs else []
        self.rank = {w.encode(): r for r, w in enumerate(order)}
        rank = {w: r for r, w in enumerate(order)}
        self.sets = [frozenset(rank[w] for w in s.words) for s in specs]
        self.named = [frozenset(rank[w] for w in s.naming) for s in specs]
        self.classes = []  # per block length: its words, prefix index, least need
        for block in sorted({s.block for s in specs}):
            own = [t for t, s in enumerate(specs) if s.block == block]
            first: dict[int, list[tuple[int, int]]] = {}
            for t in own:
                for place, r in enumerate(sorted(self.sets[t])[: len(self.sets[t]) - specs[t].need + 1]):
                    first.setdefault(r, []).append((t, place))
            self.classes.append((block, frozenset().union(*(self.sets[t] for t in own)), first, min(specs[t].need for t in own)))
        self.prefix_words = frozenset(w for w, r in self.rank.items() if any(r in c[2] for c in self.classes))
        self.stats: Counter = Counter()

    def join(self, words: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(template, first word of the block, words that the block holds of it) of every pair that meets the threshold."""
        if self.prefix_words.isdisjoint(words):
            return
        ranks = [self.rank.get(w, -1) for w in words]
        for block, vocabulary, first, least in self.classes:
            step = block // 2
            for b in sorted({x for i, r in enumerate(ranks) if r in first for x in (i // step, i // step - 1) if x >= 0}):
                own = sorted(vocabulary.intersection(ranks[b * step : b * step + block]))
                shared: dict[int, int] = {}  # words shared so far; -1: can't reach the threshold
                for place, r in enumerate(own):
                    left = len(own) - place
                    if left < least:  # the block's own prefix ends: what is left can't fill any template
                        break
                    for t, at in first.get(r, ()):
                        have = shared.get(t)
                        if have is None:
                            self.stats["prefix"] += 1
                            have = 0 if len(own) >= self.specs[t].need else -1
                            self.stats["short"] += have < 0
                        if have >= 0 and have + min(left, len(self.sets[t]) - at) < self.specs[t].need:
                            self.stats["placed"] += 1
                            have = -1
                        shared[t] = have + 1 if have >= 0 else -1
                for t, some in shared.items():
                    if some > 0:
                        self.stats["counted"] += 1
                        have = len(self.sets[t].intersection(own))
                        if have >= self.specs[t].need:
                            self.stats["met"] += 1
                            yield t, b * step, have

    def places(self, words: list[bytes], t: int, start: int) -> list[int]:
        """Where a phrase's words stand consecutively inside a block."""
        phrase = tuple(w.encode() for w in self.specs[t].phrase)
        own = words[start : start + self.specs[t].block]
        return [start + i for i in range(len(own) - len(phrase) + 1) if own[i] == phrase[0] and tuple(own[i : i + len(phrase)]) == phrase]

    def named_in(self, words: list[bytes], t: int, start: int) -> bool:
        """Whether a block has all naming words of a template."""
        return not self.named[t] or self.named[t].issubset(self.rank.get(w, -1) for w in words[start : start + self.specs[t].block])

    def document(self, words: list[bytes]) -> tuple[list[tuple[int, str]], dict[str, float], int]:
        """Base places (start, label), in order; the largest containment of each label; how many pairs of block and template met the threshold."""
        places: set[tuple[int, str]] = set()
        best: dict[str, float] = {}
        met = 0
        for t, start, have in self.join(words):
            spec = self.specs[t]
            if spec.phrase:
                found = self.places(words, t, start)
                places.update((i, spec.label) for i in found)
                if not found:
                    continue
            else:
                met += 1
                if not self.named_in(words, t, start):
                    continue
            best[spec.label] = max(best.get(spec.label, 0.0), have / len(spec.words))
        return sorted(places), best, met


def _count(vocabulary: frozenset[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in slices(batches, "text"):
            for text in byte_texts(batch.column("text")):
                total.update(filter(vocabulary.__contains__, text.translate(WORD_TABLE).split()))
        yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in total], pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return run


def word_counts(docs: DataFrame, specs: list[Spec], text_col: str = "text") -> dict[str, int]:
    """How often the whole corpus has each word of the templates: a row for each of them at most comes to the driver."""
    vocabulary = frozenset(w.encode() for s in specs for w in s.words)
    counts = docs.select(F.col(text_col).alias("text")).mapInArrow(_count(vocabulary), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counts.collect()}


BLOCKS = pa.schema([("doc_id", pa.int64()), ("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64()), ("named", pa.bool_())])


def license_blocks(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, naming: frozenset[str] = NAMING, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The join itself: (doc_id, template, label, first_word, n_words, containment, named) of every block that meets a template's threshold.

    Null texts have no blocks. `template` counts phrases first; named: the block has all naming words of the template.
    """
    specs = specs_of(phrases, templates, containment, naming, block)
    counts = word_counts(docs, specs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(specs, counts)
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = text.translate(WORD_TABLE).split()
                for t, start, have in index.join(words):
                    s = specs[t]
                    out.append((doc_id, t, s.label, start, min(s.block, len(words) - start), have / len(s.words), index.named_in(words, t, start)))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), BLOCKS)], schema=BLOCKS)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, template int, label string, first_word long, n_words long, containment double, named boolean")


RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("n_blocks", pa.int64())])


def license_scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, naming: frozenset[str] = NAMING, block: int = BLOCK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks.

    n_blocks: pairs of block and template that meet the threshold. A label is given if one of its templates is met by a
    block that has the template's naming words too; score is the largest containment among the labels given. Null texts
    are empty: no words, no labels (empty strings), score 0, null places. Repeated rows and null ids keep a row each; an
    empty table gives none. Other columns, whatever their names, are ignored. The templates go to every task: they are
    meant to be as many as there are licences, not to grow with the corpus.
    """
    specs = specs_of(phrases, templates, containment, naming, block)
    counts = word_counts(docs, specs, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(specs, counts)
        for batch in slices(batches, "text"):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), byte_texts(batch.column(1))):
                words = text.translate(WORD_TABLE).split()
                places, best, met = index.document(words)
                starts = [i for i, _ in places]
                out.append((doc_id, len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(best)), max(best.values(), default=0.0), met))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), RESULT)], schema=RESULT)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")


def oracle_sql(phrases: dict[str, str] = PHRASES, templates: list[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT, naming: frozenset[str] = NAMING, block: int = BLOCK) -> str:
    """license_scan in DuckDB's SQL: every block is compared with every template."""
    listed = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    specs = specs_of(phrases, templates, containment, naming, block)
    known = ", ".join(f"({t}, '{s.label}', {listed(sorted(s.words))}, {s.need}, {listed(sorted(s.naming))}::VARCHAR[], {s.block})" for t, s in enumerate(specs) if not s.phrase)
    base = ", ".join(f"('{s.label}', {listed(s.phrase)})" for s in specs if s.phrase)
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
p(label, phrase) AS (VALUES {base}), t(t, label, words, need, naming, block) AS (VALUES {known}),
spot AS (SELECT rid, label, i - 1 AS i FROM (SELECT rid, w, label, phrase, unnest(range(1, len(w) - len(phrase) + 2)) AS i FROM d, p WHERE len(w) >= len(phrase)) WHERE w[i:i + len(phrase) - 1] = phrase),
bl AS (SELECT rid, block, list_distinct(w[b * block // 2 + 1 : b * block // 2 + block]) AS held FROM (SELECT rid, w, block, unnest(range(0, CAST(ceil(len(w) / (block / 2)) AS BIGINT))) AS b FROM d, (SELECT DISTINCT block FROM t))),
met AS (SELECT rid, label, len(list_intersect(held, words)) / CAST(len(words) AS DOUBLE) AS share, len(list_intersect(held, naming)) = len(naming) AS named FROM bl JOIN t USING (block) WHERE len(list_intersect(held, words)) >= need),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM spot GROUP BY 1),
labels AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT rid, label, share FROM met WHERE named UNION ALL SELECT rid, label, CAST(1 AS DOUBLE) FROM spot) GROUP BY 1),
n AS (SELECT rid, count(*) AS n_blocks FROM met GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n_base, 0) AS n_base, first_word, last_word, COALESCE(base_labels, '') AS base_labels, COALESCE(labels, '') AS labels, COALESCE(score, CAST(0 AS DOUBLE)) AS score, COALESCE(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base USING (rid) LEFT JOIN labels USING (rid) LEFT JOIN n USING (rid)"""
