"""Toxicity: a weighted lexicon, matched by Aho-Corasick in folded text.

Folding lowers, strips accents, maps homoglyphs to Latin letters and digits to the letters they stand for (l, 1
and i become one), drops zero-width characters and turns all else into single spaces. Terms are whole words
or word beginnings; their weights are log odds learnt from labelled texts. A hit inside an exception
phrase does not count. The sum of the weights and that sum per hundred words (normalised by length) go through a
logistic curve that is fitted on the same labelled texts.

The classifier (terms, weights, exceptions, curve) is fitted on at most FIT_ROWS labelled texts, taken by a
hash of their ids, and holds every term and phrase of theirs that the evidence bears out: the sample alone bounds it. Scoring covers all rows and whole texts.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from dataclasses import dataclass, field
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType

from .common import materialize, text_or_empty

#: labelled rows that the classifier is fitted on, at most
FIT_ROWS = 24_000
BEGINNINGS = (4, 5, 6, 7)
#: least evidence for a term (log-likelihood ratio) and least share of toxic texts among those that hold it
EVIDENCE, SHARE = 14.0, 0.6

# fixed values: insults in use before any label is seen, and harmless phrases that hold such words
SEED_TERMS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "imbecile", "dumb")
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "trash collection", "clown fish", "sore loser", "dumb bell", "dumb waiter")

# fixed values: letters of other scripts, and digits, that look like a Latin letter
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ℓ": "i", "ß": "ss", "ø": "o", "đ": "d", "ł": "i", "æ": "ae", "œ": "oe",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "l": "i", "@": "a", "$": "s",
}
#: signs that stand for a letter only between letters
_SIGNS = "@$"


class _Fold(dict):
    """One character's folded form, found by rule when first met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if unicodedata.category(char) in ("Cf", "Mn", "Me"):
            out = ""
        else:
            out = "".join(HOMOGLYPHS.get(c, c) if c.isalnum() else " " for x in unicodedata.normalize("NFKD", char).lower() for c in unicodedata.normalize("NFKD", x if x in _SIGNS else HOMOGLYPHS.get(x, x)) if not unicodedata.combining(c))
        self[code] = out
        return out


_FOLD = _Fold()
_ASCII = bytes(ord(_FOLD[i]) if len(_FOLD[i]) == 1 else 32 for i in range(128)) + bytes(range(128, 256))


def fold(text: str | None) -> str:
    """The folded words, each between single spaces: " you idiot "; "" where there are none."""
    text = text or ""
    for sign in _SIGNS:
        if sign in text:
            text = re.sub(rf"(?<=[^\W_]){re.escape(sign)}(?=[^\W_])", HOMOGLYPHS[sign], text)
    text = text.encode().translate(_ASCII).decode() if text.isascii() else text.translate(_FOLD)
    words = text.split()
    return f" {' '.join(words)} " if words else ""


def terms_of(folded: str) -> set[str]:
    """Candidate terms: " word " and " begin" of the folded words."""
    words = set(folded.split())
    out = {f" {w} " for w in words if 3 <= len(w) <= 24}
    for n in BEGINNINGS:
        out.update(f" {w[:n]}" for w in words if len(w) > n)
    return out


@dataclass
class Lexicon:
    weights: dict[str, float]
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-3.0, 2.0, 1.0)  # of 1, log(1 + sum), log(1 + sum per 100 words)
    _automaton: object = None

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_automaton": None}

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for term, weight in self.weights.items():
                a.add_word(term, (len(term), weight))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight); of terms that begin at the same word the heaviest counts, none inside an exception."""
        a = self.automaton()
        if not len(a) or not folded:
            return []
        best: dict[int, tuple[int, int, float]] = {}
        spared: list[tuple[int, int]] = []
        for last, (size, weight) in a.iter(folded):
            start, end = last + 1 - size, last + 1
            if weight is None:
                spared.append((start, end))
            elif start not in best or weight > best[start][2]:
                best[start] = (start, end, weight)
        if not spared:
            return list(best.values())
        spared.sort()
        starts = [s for s, _ in spared]
        reach = list(accumulate((e for _, e in spared), max))  # the farthest end of all spans up to one
        return [h for h in best.values() if not ((n := bisect_right(starts, h[0])) and reach[n - 1] >= h[1])]

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return np.log1p(total), np.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return float(1 / (1 + np.exp(-np.clip(a + b * x + c * y, -30, 30))))


def _evidence(toxic, clean, n_toxic, n_clean):
    """Log-likelihood ratio of a term's share of toxic texts against the overall share."""
    n, p0 = toxic + clean, n_toxic / max(1, n_toxic + n_clean)
    p = toxic / n
    q = np.clip(p, 1e-9, 1 - 1e-9)
    return toxic * np.log(q / max(p0, 1e-9)) + clean * np.log((1 - q) / max(1 - p0, 1e-9))


def _curve(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton steps; slopes are held to be non-negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + ridge * w * [0, 1, 1]
        h = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-6, ridge, ridge])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(max(w[1], 0)), float(max(w[2], 0))


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> Lexicon:
    """A lexicon from the labelled rows whose crc32(id as text) mod 5 is not 0, at most fit_rows of them.

    Rows without a label, an id or a text are not used; of texts that fold to the same words one is, the smallest (copies would pass for evidence).
    Too few labels: the seed terms with the default curve.
    """
    spark = docs.sparkSession
    mine = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    mine = mine.where(~held_out("__id")).orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("text"))
    sample = texts.join(F.broadcast(mine), "__id")  # at most fit_rows ids

    @F.pandas_udf(BinaryType())
    def form(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.blake2b(fold(t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for t in texts])

    sample = materialize(sample.groupBy(form("text").alias("form"), "y").agg(F.min("text").alias("text")).select("text", "y"), "labelled")
    counts = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = counts.get(1, 0), counts.get(0, 0)
    seeds = {f" {fold(t).strip()} ": 1.0 for t in SEED_TERMS}
    exceptions = [fold(p) for p in EXCEPTIONS]
    if min(n_toxic, n_clean) < 4:
        return Lexicon(seeds, exceptions)

    def count(batches):
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                (toxic if y else clean).update(terms_of(fold(text)))
        for counter, y in ((toxic, 1), (clean, 0)):
            keys = list(counter)
            for at in range(0, len(keys), 8192):
                part = keys[at : at + 8192]
                n = [counter[k] for k in part]
                zero = [0] * len(part)
                yield pa.RecordBatch.from_pydict({"term": part, "toxic": n if y else zero, "clean": zero if y else n}, pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())]))

    found = sample.mapInArrow(count, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = found.where((F.col("toxic") >= 3) & (F.col("toxic") >= SHARE * (F.col("toxic") + F.col("clean"))))
    found = found.toPandas()  # terms of fit_rows texts
    found["evidence"] = _evidence(found.toxic.to_numpy(float), found.clean.to_numpy(float), n_toxic, n_clean) if len(found) else []
    found = found[found.evidence >= EVIDENCE].sort_values(["evidence", "term"], ascending=[False, True]) if len(found) else found
    odds = n_toxic / n_clean
    weights: dict[str, float] = {}
    toxic_of = dict(zip(found.term, found.toxic, strict=True)) if len(found) else {}
    for row in found.itertuples():
        # a beginning as good as a longer one stands for it
        if any(row.term[:n] in weights and toxic_of[row.term[:n]] >= row.toxic for n in range(4, len(row.term.rstrip()))):
            continue
        weights[row.term] = float(np.log((row.toxic + 0.5) / (row.clean + 0.5) / odds))
    top = max(weights.values(), default=1.0)
    weights = {t: w / top for t, w in weights.items() if w > 0}
    lexicon = Lexicon(seeds | weights, exceptions)
    lexicon.exceptions = sorted({*exceptions, *_clean_phrases(sample, lexicon)})

    def measure(batches):
        for batch in batches:
            xy = [lexicon.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"a": [x for x, _ in xy], "b": [y for _, y in xy], "y": batch["y"].cast(pa.int64())})

    measured = sample.mapInArrow(measure, "a double, b double, y long").toPandas()  # fit_rows rows at most
    lexicon.curve = _curve(measured[["a", "b"]].to_numpy(), measured.y.to_numpy(float))
    return lexicon


def _clean_phrases(sample: DataFrame, lexicon: Lexicon) -> list[str]:
    """Two-word phrases with a term that stand, in the labelled texts, almost only in clean ones."""

    def phrases(batches):
        for batch in batches:
            rows: list[tuple[str, int]] = []
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist(), strict=True):
                folded, seen = fold(text), set()
                for start, end, _ in lexicon.hits(folded):
                    word_end = folded.index(" ", max(end - 1, start + 1))
                    after = folded.find(" ", word_end + 1)
                    before = folded.rfind(" ", 0, start)
                    if after > 0:
                        seen.add(folded[start : after + 1])
                    if before >= 0:
                        seen.add(folded[before : word_end + 1])
                rows += [(p, y) for p in seen]
            yield pa.RecordBatch.from_pydict({"phrase": [p for p, _ in rows], "y": [y for _, y in rows]}, pa.schema([("phrase", pa.string()), ("y", pa.int64())]))

    found = sample.mapInArrow(phrases, "phrase string, y long").groupBy("phrase").agg(F.sum(1 - F.col("y")).alias("clean"), F.count("*").alias("n"))
    return [r.phrase for r in found.where("clean >= 4 and clean >= 0.9 * n").collect()]  # phrases of fit_rows texts


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5, is 0; a null id counts as empty text (and so is held out)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def score_column(docs: DataFrame, lexicon: Lexicon, text_col: str = "text"):
    """The score as a column; a null text counts as empty, and an empty text has the curve's lowest score."""
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)  # terms of FIT_ROWS texts at most

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return score(text_or_empty(text_col))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below threshold, with the columns of docs."""
    return docs.where(score_column(docs, lexicon, text_col) < threshold)
