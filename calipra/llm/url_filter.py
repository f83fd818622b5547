"""URL filters: rules by host and path, and for all other URLs boosted trees on lexical features."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from calipra.llm.boosting import BoostedTrees

#: (verdict, rule): a host, whose subdomains fit as well, and what the path starts with. Of rules that fit, the longest wins.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: At least so likely to be a URL to block: block.
THRESHOLD = 0.5
#: The model is fitted on the driver, on so many labelled URLs at most: of each label as many, those of the least hashes.
MAX_LABELLED = 20_000

_PARTS = re.compile(r"(?s)^.*?://([^/?#]*)([^?#]*)")


def parts(url: str | None) -> tuple[str, str]:
    """Host (after the first ://, A-Z lower-cased) and path of a URL; both empty where there is no ://."""
    m = _PARTS.match(url or "")
    return (m[1].translate(_LOWER), m[2]) if m else ("", "")


_LOWER = {c: c + 32 for c in range(65, 91)}


class Rules:
    def __init__(self, rules=RULES):
        self.by_host: dict[str, list[tuple[int, str, str, str]]] = {}
        for verdict, rule in rules:
            host, slash, path = rule.partition("/")
            self.by_host.setdefault(host, []).append((len(rule), slash + path, rule, verdict))

    def match(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) of the longest rule that fits, or None. Looks up each suffix of the host, so rules may be many."""
        best, at = None, 0
        while host:
            for n, start, rule, verdict in self.by_host.get(host[at:], ()):
                if path.startswith(start) and (best is None or n > best[0]):
                    best = (n, rule, verdict)
            at = host.find(".", at) + 1
            if not at:
                break
        return best and best[1:]


def _entropy(s: str) -> float:
    return -sum(k / len(s) * math.log2(k / len(s)) for k in Counter(s).values()) if s else 0.0


class UrlModel:
    """Lexical features of URLs and the trees fitted to them. Statistics of suffixes come from the labelled URLs alone.

    A suffix in withheld has none: where labels come from rules, those that rules name would only restate them.
    """

    def __init__(self, labelled: list[tuple[str | None, int]], withheld: frozenset[str] = frozenset(), prior: float = 20.0):
        hits: Counter = Counter()
        seen: Counter = Counter()
        for url, y in labelled:
            seen[top := self._suffix(url)] += 1
            hits[top] += y
        self.mean = (sum(hits.values()) + 1) / (sum(seen.values()) + 2)
        self.rate = {k: (hits[k] + prior * self.mean) / (n + prior) for k, n in seen.items() if n >= 3 and k not in withheld}
        self.trees = BoostedTrees().fit(self._matrix([u for u, _ in labelled]), np.array([y for _, y in labelled]))

    @staticmethod
    def _suffix(url: str | None) -> str:
        return parts(url)[0].rpartition(".")[2].partition(":")[0]

    def features(self, url: str | None) -> list[float]:
        """Lengths, depth, parts of the host, shares of digits, entropies, parameters, and the rate of label 1 under the suffix."""
        url = url or ""
        host, path = parts(url)
        query = url.partition("?")[2].partition("#")[0]
        digits = sum(c.isdigit() for c in url) / max(len(url), 1)
        host_digits = sum(c.isdigit() for c in host) / max(len(host), 1)
        return [len(url), len(host), len(path), path.count("/"), host.count("."), host.count("-"), host_digits, digits, _entropy(host), _entropy(path), _entropy(url), len([q for q in query.split("&") if q]), len(query), self.rate.get(self._suffix(url), self.mean)]

    def _matrix(self, urls: list[str | None]) -> np.ndarray:
        return np.array([self.features(u) for u in urls], float).reshape(len(urls), len(self.features(None)))

    def scores(self, urls: list[str | None]) -> np.ndarray:
        """The chance that each URL is one to block."""
        return self.trees.predict(self._matrix(urls))


def rule_labels(pages: DataFrame, rules=RULES, url: str = "url") -> DataFrame:
    """(url, label) of the URLs that a rule decides, label 1 for block: labels that the data itself gives. Null and odd URLs fit no rule."""
    table = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, m[1]) for u in batch.column(0).to_pylist() if (m := table.match(*parts(u)))]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in found], pa.string()), pa.array([int(v == "block") for _, v in found], pa.int32())], names=["url", "label"])

    return pages.select(url).mapInArrow(run, "url string, label int")


def rule_suffixes(rules=RULES) -> frozenset[str]:
    return frozenset(rule.partition("/")[0].rpartition(".")[2] for _, rule in rules)


def held_out(url: Column) -> Column:
    """Whether a labelled URL is kept from fitting, to measure the model: crc32 of it, modulo 4, is 2."""
    return F.crc32(url) % 4 == 2


def labelled_sample(labelled: DataFrame, url: str = "url", label: str = "label", limit: int = MAX_LABELLED) -> list[tuple[str, int]]:
    """At most limit labelled URLs, of both labels as many, those of the least hashes: the same ones however the table is partitioned. Nulls are left out."""
    rows = labelled.select(F.col(url).alias("u"), F.col(label).cast("int").alias("y")).dropna().distinct()
    ones, zeros = ([(r.u, r.y) for r in rows.filter(F.col("y") == y).orderBy(F.xxhash64("u"), "u").limit(limit // 2).collect()] for y in (1, 0))
    n = min(len(ones), len(zeros))
    return ones[:n] + zeros[:n]


def rule_model(pages: DataFrame, rules=RULES, url: str = "url") -> UrlModel:
    """The model of the pages' URLs that rules decide, held-out ones left out."""
    return UrlModel(labelled_sample(rule_labels(pages, rules, url).filter(~held_out(F.col("url")))), rule_suffixes(rules))


def judge_urls(pages: DataFrame, model: UrlModel, rules=RULES, threshold: float = THRESHOLD, id_col: str = "page_id", url: str = "url") -> DataFrame:
    """Per row: id, host, path, rule (null where none fits), verdict (allow or block) and score (the model's, for all rows).

    The rule's verdict holds where a rule fits; else the model's. One pass without shuffle that reads two columns; rules and model
    (some thousand numbers) travel with the code. Null, empty and odd URLs have empty host and path, and are judged by the model.
    Repeated rows stay; other columns are not read.
    """
    table = Rules(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            urls = batch.column(1).to_pylist()
            split = [parts(u) for u in urls]
            found = [table.match(*s) for s in split]
            scores = model.scores(urls)
            verdicts = [f[1] if f else ("block" if s >= threshold else "allow") for f, s in zip(found, scores, strict=True)]
            cols = [batch.column(0), pa.array([h for h, _ in split], pa.string()), pa.array([p for _, p in split], pa.string()), pa.array([f and f[0] for f in found], pa.string()), pa.array(verdicts, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[id_col, "host", "path", "rule", "verdict", "score"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url).mapInArrow(run, f"{id_col} {kind}, host string, path string, rule string, verdict string, score double")
