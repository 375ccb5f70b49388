"""Toxicity through a noisy channel: hidden words are restored by Viterbi decoding, then the restored text is scored.

A character trigram model is counted over all documents. Words that mix letters with look-alike signs, at their edges
too, repeat a letter or are spelt out with separators become a lattice: each character may stand for itself, for the letters it
looks like, for nothing (separators), or repeat the letter before it. Viterbi decoding under the model picks the word.
Restored texts are scored by words and word beginnings that labelled rows show to be toxic beyond chance.

Defined cases: null and empty texts get the score of a text without any toxic word; without labelled rows scores are the
prior 0.5; of labelled rows that repeat an id the smallest text is learnt; repeated rows are scored alike; very long texts and words are read whole, in time that grows with their length; extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, whole_text
from .labelled import held_out, logistic, sample

#: Labelled rows that a model learns from at most.
SAMPLE = 12000
#: Lengths of word beginnings that are scored besides whole words.
BEGINNINGS = (4, 5, 6)
#: A feature needs this many toxic rows, this share of toxic rows, and a likelihood ratio beyond what chance gives in that many trials.
SUPPORT, PRECISION, MARGIN = 5, 0.8, 6.0
#: Words that a worker's cache may hold before it starts anew; it bounds memory, not results.
CACHE_WORDS = 500_000
# Letters that a sign can stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'`^,:;#/\\()[]{}&%?\"=<>"
#: Log costs of the channel's choices.
COST_LOOK, COST_DROP, COST_REPEAT = -1.0, -0.7, -0.5
_ALPHABET = 28  # word boundary, a to z, any other letter
_CODES = np.array([27 * chr(k).isalpha() for k in range(0x10000)], dtype=np.int64)
_CODES[97:123] = range(1, 27)
_LETTER, _LOOK, _SIGN, _TRIPLE = (re.compile(p) for p in (r"[^\W\d_]", "[0-9@$!|+€£]", r"[^\w\s]", r"([^\W\d_])\1\1"))
#: Single signs with separators between them; each sign of a text is looked at by one run only.
_X = r"(?:[^\W_]|[@$!|+€£])"
_RUN = re.compile(rf"(?<![^\s.\-_*]){_X}(?!{_X})(?:[ .\-_*]{{1,3}}{_X}(?!{_X})){{3,}}")
_SINGLE, _OPEN, _SHUT = re.compile(_X), re.compile(rf"(?<!\S){_X}"), re.compile(rf"{_X}(?!\S)")
#: A letter that stands alone before a spelt-out run may be a word of its own.
_ALONE = re.compile(r"[^\W\d_] +")
_DOUBLE = re.compile(r"([^\W\d_])\1")
_EDGE = " \t.,;:!?\"'()[]{}*%&$#"
#: Edge signs that stand for no letter.
_BLANK_EDGE = "".join(c for c in _EDGE if c not in LOOKS)


def codes(text: str) -> np.ndarray:
    return _CODES[np.minimum(np.frombuffer(text.encode("utf-32-le"), dtype="<u4"), 0xFFFF)]


def character_model(texts: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of the third character after two, from all texts; at most 28^3 counts leave a task."""

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = np.zeros(_ALPHABET**3, dtype=np.int64)
        for b in batches:
            for t in b["text"]:
                c = np.r_[0, 0, codes(t.lower()), 0]
                n += np.bincount((c[:-2] * _ALPHABET + c[1:-1]) * _ALPHABET + c[2:], minlength=len(n))
        at = np.flatnonzero(n)
        yield pd.DataFrame({"gram": at, "n": n[at]})

    n = np.zeros(_ALPHABET**3)
    for r in texts.select("text").mapInPandas(count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        n[r["gram"]] = r["n"]
    n = n.reshape(_ALPHABET, _ALPHABET, _ALPHABET)
    pairs = (n.sum(0) + 0.5) / (n.sum((0, 1))[None, :].sum() / _ALPHABET + 0.5)
    pairs /= pairs.sum(1, keepdims=True)
    return np.log((n + 8 * pairs[None, :, :]) / (n.sum(2, keepdims=True) + 8))


def restore(word: str, logp: np.ndarray, drop_looks: bool = True) -> str:
    """The likeliest word behind a lower-case lattice word: Viterbi over states of the last two letters.

    Without drop_looks, signs that can be letters are letters.
    """
    # What was read so far is a chain of (before, letter): states share it, and a step costs the same in any word.
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for ch in word:
        options = [(x, COST_LOOK) for x in LOOKS.get(ch, "")] or ([(ch, 0.0)] if ch.isalpha() else [])
        drop = COST_DROP if (ch in SEPARATORS or not ch.isalpha()) and (drop_looks or ch not in LOOKS) else None
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (s, out) in states.items():
            moves = [] if drop is None else [((a, b), s + drop, out)]
            for x, cost in options:
                c = int(_CODES[min(ord(x), 0xFFFF)])
                moves.append(((b, c), s + cost + logp[a, b, c], (out, x)))
                if out and out[1] == x:
                    moves.append(((a, b), s + COST_REPEAT, out))
            for state, score, text in moves:
                if state not in best or score > best[state][0]:
                    best[state] = (score, text)
        states = best or states
    ends = [(s + logp[a, b, 0], out) for (a, b), (s, out) in states.items()]
    top = max(s for s, _ in ends)
    return max(_read(out) for s, out in ends if s == top)


def _read(chain: tuple | None) -> str:
    letters = []
    while chain:
        chain, x = chain
        letters.append(x)
    return "".join(reversed(letters))


def odd(word: str) -> bool:
    """Whether a word holds a letter, and a look-alike sign, another sign before a letter, or three equal letters in a row."""
    if word.isalpha():
        return _TRIPLE.search(word) is not None
    if not _LETTER.search(word):
        return False
    sign = _SIGN.search(word)
    return bool(_LOOK.search(word) or (sign and _LETTER.search(word, sign.end())) or _TRIPLE.search(word))


def spelt(text: str) -> Iterator[str]:
    """Runs of four and more single signs with separators, from one that follows white space to the last before white space."""
    for m in _RUN.finditer(text):
        first, last = _OPEN.search(text, m.start(), m.end()), None
        for last in _SHUT.finditer(text, m.start(), m.end() + 1):
            pass
        if first and last and last.start() > first.start():
            run = text[first.start() : last.end()]
            if len(_SINGLE.findall(run)) > 3:
                yield run


class Restorer:
    """Distinct restored words of texts, by a bounded cache of words."""

    def __init__(self, logp: np.ndarray) -> None:
        self.logp, self.cache = logp, {}

    def _word(self, word: str) -> tuple[str, ...]:
        """What a word may read as; edge signs that can be letters and doubled letters leave the plain reading beside the decoded one."""
        bare, edged = word.strip(_EDGE), word.strip(_BLANK_EDGE)
        if odd(bare):
            return (restore(word, self.logp),)
        if edged != bare and any(map(str.isalpha, bare)):
            return (bare, restore(edged, self.logp), restore(edged, self.logp, drop_looks=False))
        return (bare, restore(bare, self.logp)) if _DOUBLE.search(bare) else (bare,)

    def words(self, text: str) -> set[str]:
        text, cache = text.lower(), self.cache
        found = set(text.split())
        if new := [w for w in found if w not in cache]:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                new = list(found)
            cache.update({w: self._word(w) for w in new})
        out = {x for w in found for x in cache[w]}
        for run in spelt(text):
            out.add(restore(run, self.logp))
            if alone := _ALONE.match(run):
                out.add(restore(run[alone.end() :], self.logp))
        return out


def features(words: Iterable[str]) -> set[str]:
    return {f for w in words if w for f in (w, *(w[:k] + "+" for k in BEGINNINGS if len(w) > k))}


def fit(docs: DataFrame, labels: DataFrame, logp: np.ndarray) -> tuple[dict[str, float], list[float]]:
    """(weights of features, calibration). The features kept are those that pass SUPPORT, PRECISION and MARGIN."""
    # Few rows (SAMPLE at most), written once. Two thirds choose the features, the rest sets the calibration.
    rows = cut(sample(docs, labels, "toxic", SAMPLE, False).select("doc_id", "text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0).alias("rest")), "toxic-sample")

    def count(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hits, restorer = {0: Counter(), 1: Counter()}, Restorer(logp)
        for b in batches:
            for t, y in zip(b["text"], b["label"]):
                hits[y].update(features(restorer.words(t)))
                hits[y][""] += 1
        names = list(hits[0].keys() | hits[1].keys())
        if names:
            yield pd.DataFrame({"feature": names, "n0": [hits[0][x] for x in names], "n1": [hits[1][x] for x in names]})

    # The counts are summed by Spark and only features with support come back.
    counts = cut(rows.where("NOT rest").mapInPandas(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")), "toxic-counts")
    total, trials = counts.where("feature = ''").first(), counts.count()
    if not total or not total["n1"] or not total["n0"]:
        return {}, [0.0, 0.0, 0.0 if not total else (6.0 if total["n1"] else -6.0)]
    p = total["n1"] / (total["n0"] + total["n1"])
    weights = {}
    for r in counts.where((F.col("n1") >= SUPPORT) & (F.col("n1") >= PRECISION * (F.col("n0") + F.col("n1"))) & (F.col("feature") != "")).collect():
        n0, n1 = r["n0"], r["n1"]
        gain = n1 * math.log(n1 / (n0 + n1) / p) + (n0 * math.log(n0 / (n0 + n1) / (1 - p)) if n0 else 0.0)
        if gain > math.log(max(trials, 2)) + MARGIN:
            weights[r["feature"]] = math.log((n1 + 0.5) / (total["n1"] + 1)) - math.log((n0 + 0.5) / (total["n0"] + 1))

    def raw(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(logp)
        for b in batches:
            x = [evidence(restorer.words(t), weights) for t in b["text"]]
            yield pd.DataFrame({"a": [v[0] for v in x], "b": [v[1] for v in x], "label": b["label"]})

    got = rows.where("rest").mapInPandas(raw, "a double, b double, label int").collect()
    return weights, logistic([[r["a"], r["b"]] for r in got], [r["label"] for r in got]).tolist()


def evidence(words: set[str], weights: dict[str, float]) -> tuple[float, float]:
    """The strongest word's weight and the sum over words, the latter squeezed; a word counts by its best feature."""
    best = sorted((max((weights[f] for f in features([w]) if f in weights), default=0.0) for w in words), reverse=True)
    return (best[0], math.log1p(sum(best))) if best else (0.0, 0.0)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, texts: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted; with texts also the restored toxic words."""
    rows = whole_text(docs)
    logp = character_model(rows)
    weights, (wa, wb, bias) = fit(docs, labels, logp)
    schema = "doc_id long, score double" + ", words array<string>" * texts

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer, known = Restorer(logp), {}
        for b in batches:
            out = []
            for t in b["text"]:
                words = restorer.words(t)
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in (w for w in words if w not in known):
                    known[w] = max((weights[f] for f in features([w]) if f in weights), default=0.0)
                best = [x for x in map(known.__getitem__, words) if x]
                z = wa * max(best, default=0.0) + wb * math.log1p(sum(best)) + bias
                out.append((1 / (1 + math.exp(-max(-30.0, min(30.0, z)))), *([sorted(w for w in words if known[w])] * texts)))
            yield pd.DataFrame({"doc_id": b["doc_id"], "score": [x[0] for x in out], **({"words": [x[1] for x in out]} if texts else {})})

    return rows.mapInPandas(run, schema).select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"), *(["words"] * texts)
    )
