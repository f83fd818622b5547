"""Toxicity: a lexicon learned from labels, Levenshtein automata over its trie, and scores of the context of what they find."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calipra.llm.boosting import BoostedTrees
from calipra.llm.common import bound_batches

THRESHOLD = 0.3
#: The model is fitted on the driver, on so many labelled rows at most (those of the least hashes), of texts up to so many characters each and together.
MAX_LABELLED, MAX_CHARS, ALL_CHARS = 8_000, 40_000, 40_000_000
#: A term is in so many toxic training documents at least, and so many times as frequent there as in others.
MIN_DOCS, MIN_RATIO = 4, 8.0
#: Letters of a stem at least; letters of a word at least that may have an error, and errors.
STEM, FUZZY, ERRORS = 4, 5, 1
#: Words on each side of a term that are its context; words a worker remembers.
CONTEXT, CACHE_WORDS = 6, 150_000

# What opens or closes a quotation, and words that report what others said (English, French, German, Spanish).
QUOTES = "\"“”„«»‹›"
REPORTING = frozenset("said says wrote called quoted quote according dit écrit selon appelé cite sagte schrieb nannte laut zitat dijo escribió llamó según cita".split())

_WORD = re.compile(r"[^\W\d_]+")
_TOKEN = re.compile(rf"[^\W\d_]+|[{QUOTES}\n]")


class Trie:
    """Terms as paths: node 0 is the root, next holds each node's children, and weight what a term that ends there weighs."""

    def __init__(self, terms: dict[str, float]):
        self.next: list[dict[str, int]] = [{}]
        self.weight: list[float] = [0.0]
        for term, w in terms.items():
            at = 0
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.weight.append(0.0)
                at = self.next[at][c]
            self.weight[at] = w

    def exact(self, word: str) -> float:
        at = 0
        for c in word:
            at = self.next[at].get(c)
            if at is None:
                return 0.0
        return self.weight[at]

    def stem(self, word: str) -> float:
        """The weight of the longest term that the word starts with."""
        at, best = 0, 0.0
        for c in word:
            at = self.next[at].get(c)
            if at is None:
                break
            best = self.weight[at] or best
        return best


class Automaton:
    """All words within some errors of a trie's terms: the Levenshtein automata of all inputs, intersected with the trie.

    A state is the set of (node, errors so far) that an input can have come to; states and moves are made when first met and
    kept, so that a word costs a look-up a letter. Most words come to the empty state, which has no way out, after a few.
    """

    def __init__(self, trie: Trie, errors: int = ERRORS):
        self.trie, self.errors = trie, errors
        self.ids: dict[frozenset, int] = {}
        self.moves: list[dict[str, int]] = []
        self.sets: list[frozenset] = []
        self.accepts: list[float] = []
        self.none = self._state({})
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached)
        while todo:  # letters of the term that the input leaves out
            node = todo.pop()
            e = reached[node] + 1
            if e <= self.errors:
                for child in self.trie.next[node].values():
                    if e < reached.get(child, self.errors + 1):
                        reached[child] = e
                        todo.append(child)
        key = frozenset(reached.items())
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            self.accepts.append(max((self.trie.weight[n] for n, _ in key), default=0.0))
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state]:
            child = self.trie.next[node].get(c)
            if child is not None:
                reached[child] = min(e, reached.get(child, e))
            if e < self.errors:  # a letter too many, or another one
                for n in (node, *self.trie.next[node].values()):
                    reached[n] = min(e + 1, reached.get(n, e + 1))
        self.moves[state][c] = out = self._state(reached)
        return out

    def weight(self, word: str) -> float:
        """The greatest weight of a term that is within the errors of the word; 0 if there is none."""
        at = self.start
        for c in word:
            to = self.moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if at == self.none:
                return 0.0
        return self.accepts[at]


class Lexicon:
    """Words and stems that toxic documents have far more often than others, with log ratios of their rates as weights."""

    def __init__(self, rows: list[tuple[str, int]]):
        words, docs = (Counter(), Counter()), Counter()
        for text, y in rows:
            own = _WORD.findall(text.lower())  # not kept: word lists take many times the memory of texts
            words[y].update(own)
            if y:
                docs.update({t for w in set(own) for t in self._terms(w)})
        often = {t for t, n in docs.items() if n >= MIN_DOCS}
        counts = (Counter(), Counter())
        for y in (0, 1):
            for w, n in words[y].items():
                for t in self._terms(w):
                    if t in often:
                        counts[y][t] += n
        rate = (words[0].total() + 1) / (words[1].total() + 1)
        ratio = {t: rate * (counts[1][t] + 0.5) / (counts[0][t] + 0.5) for t in often}
        weights = {t: math.log(r) for t, r in ratio.items() if r >= MIN_RATIO}
        self.words, self.stems = ({t: w for (t, whole), w in weights.items() if whole == kind} for kind in (True, False))
        self._built()
        # words of documents with label 0 are themselves, not errors of others
        self.known = {w for w in words[0] if len(w) >= FUZZY - ERRORS and self.automaton.weight(w)}
        self.cache: dict[str, tuple[float, float, float]] = {}

    @staticmethod
    def _terms(word: str) -> list[tuple[str, bool]]:
        """A word as a term, and the stems that it starts with."""
        return [(word, True), *((word[:k], False) for k in range(STEM, len(word)))]

    def _built(self) -> None:
        self.word_trie, self.stem_trie = Trie(self.words), Trie(self.stems)
        self.automaton = Automaton(Trie({w: x for w, x in self.words.items() if len(w) >= FUZZY}))

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "known": self.known}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.cache = {}
        self._built()

    def found(self, word: str) -> tuple[float, float, float] | None:
        """Weights of a word as a term, by its stem, and as a term with errors; None if it has none."""
        exact = self.word_trie.exact(word)
        stem = self.stem_trie.stem(word)
        fuzzy = 0.0 if exact or len(word) < FUZZY - ERRORS or word in self.known else self.automaton.weight(word)
        return (exact, stem, fuzzy) if exact or stem or fuzzy else None

    def matches(self, words: list[str]) -> list:
        """For each word what found() says."""
        cache, out = self.cache, []
        for w in words:
            try:
                out.append(cache[w])
            except KeyError:
                if len(cache) >= CACHE_WORDS:
                    cache.clear()
                cache[w] = m = self.found(w)
                out.append(m)
        return out


N_FEATURES = 13


def features(lexicon: Lexicon, text: str) -> list[float]:
    """Of a whole text: how many words; sums, counts and greatest weights of what the lexicon finds; the same for what stands in quotations."""
    low = text.lower()
    words = _WORD.findall(low)
    hits = lexicon.matches(words)
    n = max(len(words), 1)
    found = [h for h in hits if h]
    if not found:
        return [math.log(n)] + [0.0] * (N_FEATURES - 1)
    own = [max(h[0], h[1]) for h in found]
    quoted = _quoted(lexicon, low)
    exact = [h[0] for h in found if h[0]]
    stems = [h[1] for h in found if h[1]]
    fuzzy = [h[2] for h in found if h[2]]
    distinct = len({w for w, h in zip(words, hits, strict=True) if h and h[0]})
    return [math.log(n), sum(exact), len(exact), distinct, max(exact, default=0.0), sum(stems), len(stems), max(stems, default=0.0), len(exact) / n, len(stems) / n, sum(fuzzy), len(fuzzy), sum(own) - quoted]


def _quoted(lexicon: Lexicon, low: str) -> float:
    """The weights of terms within quotation marks of a line, or with a reporting word in their context."""
    total, line = 0.0, []

    def close() -> float:
        inside, marks, of_word = False, [], []
        for t in line:
            if t in QUOTES:
                inside = t in "“„«‹" or (t == '"' and not inside)
            else:
                of_word.append(t)
                marks.append(inside)
        hits = lexicon.matches(of_word)
        out = 0.0
        for i, h in enumerate(hits):
            if h and (marks[i] or REPORTING.intersection(of_word[max(0, i - CONTEXT) : i + CONTEXT + 1])):
                out += max(h[0], h[1])
        return out

    for t in _TOKEN.findall(low):
        if t == "\n":
            total += close()
            line = []
        else:
            line.append(t)
    return total + close()


class ToxicityModel:
    """A lexicon and boosted trees on what it finds. For fitting the trees, each half's features come from the other half's lexicon."""

    def __init__(self, rows: list[tuple[str, int]]):
        x, y = [], []
        for half in (0, 1):
            lexicon = Lexicon(rows[1 - half :: 2])
            x += [features(lexicon, t) for t, _ in rows[half::2]]
            y += [v for _, v in rows[half::2]]
        self.trees = BoostedTrees(trees=60, depth=3, rate=0.15).fit(np.array(x, float).reshape(len(x), N_FEATURES), np.array(y, float))
        self.lexicon = Lexicon(rows)

    def scores(self, texts: list[str]) -> np.ndarray:
        return self.trees.predict(np.array([features(self.lexicon, t) for t in texts], float).reshape(len(texts), N_FEATURES))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of the id as text, modulo 4, is 2. Null ids aren't."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED) -> ToxicityModel:
    """The model of a bounded sample of labelled rows, held-out ones left out. The sample is the same however the tables are partitioned.

    Without labels (or with one kind only), all scores are their rate. Of a document, only its text is used.
    """
    own = labels.select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).dropna().filter(~held_out(F.col("id"))).distinct()
    own = own.orderBy(F.xxhash64("id"), "id", "y").limit(limit)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).filter(F.char_length("text") <= MAX_CHARS)
    rows = texts.join(F.broadcast(own), "id").orderBy(F.xxhash64("id"), "id", "y", "text").limit(limit)  # own is at most limit rows
    so_far = F.sum(F.char_length("text")).over(Window.orderBy(F.xxhash64("id"), "id", "y", "text").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("so_far", so_far).filter(F.col("so_far") <= ALL_CHARS).select("text", "y").collect()
    return ToxicityModel([(r.text, r.y) for r in rows])


def score_toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per row: id, held_out, score (0 to 1) and predicted (1 if score >= threshold). One pass without shuffle; the model travels with the code.

    Null texts count as empty; these and texts without words get the score of texts without terms. Rows may repeat; null ids
    stay null; other columns are not read.
    """

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t.as_py() or "" for t in batch.column(2)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=[id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), held_out(F.col(id_col)).alias("held_out"), F.col(text)).mapInArrow(run, f"{id_col} {kind}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with all columns, whose texts score below the threshold: rows pass through Python once and nothing is shuffled or joined."""

    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores([t.as_py() or "" for t in batch.column(batch.schema.get_field_index(text))])
            yield batch.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
