"""Toxicity by fuzzy lexicon matching in context (operator 1).

A lexicon of toxic words and stems is kept in a trie.  Levenshtein automata
run over the trie from its root (one edit for words of 5 to 8 letters, two from
9, anywhere in the word; look-alike digits and signs are read as letters); their
product is made deterministic lazily, so a distinct word costs one table step
per letter until it dies.  A worker keeps the product over its tasks.  Every hit is weighed by its context window: quoting
marks and verbs of reporting speak for a quotation, second-person words for
abuse.  A logistic model over the summed context scores gives the score.

The lexicon and the model are learned from at most ``SAMPLE`` labelled rows per
class (chosen by a hash of the id; whole texts): words and 4- or 5-letter stems
that toxic texts hold far more often than clean ones and that occur in a share
``MIN_SHARE`` of the toxic texts at least.  Both are counted in groups of near
copies (texts that agree in ``HASHES`` smallest word hashes), and shares are of
groups, so copies count once.  Every term that passes is in the lexicon.

Defined cases: null and empty texts have no hits and get the model's base
score; without labelled rows of both classes the lexicon is empty and the score
the share of toxic labels (0 without labels); null labels teach nothing; several
labels of a document count as their maximum; a null id is never learned from;
rows that repeat get equal scores; extra columns stay, added ones get a leading
underscore if they clash.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ordersight.llm.common import col, free, table, written

SAMPLE = 4000
HASHES = 3
MIN_SHARE = 0.005
MIN_RATIO = 8.0
WINDOW = 60
MEMO = 1_000_000
_TOKEN = re.compile(r"[^\W_]+(?:[$@*!][^\W_]+)*")
_LOOKALIKE = str.maketrans("013457$@!*", "oieastsaii")
_QUOTE = re.compile(r"[\"“”„«»]|\b(?:said|says|wrote|called|quoted?|reported|dit|écrit|sagte|schrieb|nannte|dijo|escribió)\b")
_ABUSE = re.compile(r"\b(?:you|your|yours|yourself|tu|toi|ton|vous|votre|du|dich|dein|ihr|euch|usted|tú|eres|vosotros)\b")
FEATURES = ["hits", "fuzzy", "abuse", "quoted", "rate"]


class Lexicon:
    """Trie of words and stems, intersected with Levenshtein automata, determinised as words come."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child, self.edits, self.word, self.stem = [{}], [0], [-1], [False]
        for term, is_stem in [*((w, False) for w in words), *((s, True) for s in stems)]:
            allowed = 0 if is_stem or len(term) < 5 else 1 if len(term) < 9 else 2
            node = 0
            for ch in term:
                self.edits[node] = max(self.edits[node], allowed)
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.edits.append(0)
                    self.word.append(-1)
                    self.stem.append(False)
                node = self.child[node][ch]
            self.edits[node] = max(self.edits[node], allowed)
            if is_stem:
                self.stem[node] = True
            else:
                self.word[node] = allowed
        self.states, self.keys, self.ends, self.moves = {}, [], [], []
        self.dead = self._state({})
        self.root = self._state(self._skip({0: 0}))
        self.known: dict[str, tuple | None] = {}

    def _skip(self, at: dict) -> dict:
        """Add the positions that leave out letters of the term."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            for nxt in self.child[node].values():
                if e + 1 <= self.edits[nxt] and e + 1 < at.get(nxt, 99):
                    at[nxt] = e + 1
                    todo.append((nxt, e + 1))
        return at

    def _state(self, at: dict) -> int:
        key = tuple(sorted(at.items()))
        if key not in self.states:
            self.states[key] = len(self.moves)
            self.keys.append(key)
            self.moves.append({})
            ends = [e for n, e in key if 0 <= e <= self.word[n]]
            stem = any(self.stem[n] and e == 0 for n, e in key)
            self.ends.append((min(ends) if ends else None, stem))
        return self.states[key]

    def _step(self, state: int, ch: str) -> int:
        at: dict = {}

        def put(node, e):
            if e <= self.edits[node] and e < at.get(node, 99) or e == 0:
                at[node] = min(e, at.get(node, 99))

        for node, e in self.keys[state]:
            for c, nxt in self.child[node].items():
                put(nxt, e if c == ch else e + 1)
            put(node, e + 1)
        return self._state(self._skip(at))

    def match(self, word: str) -> tuple[str, int] | None:
        """("words" or "fuzzy" or "stems", edits) of the best reading, or None."""
        if not word.isalpha():
            word = word.translate(_LOOKALIKE)
        state, stem = self.root, False
        for ch in word:
            if state == self.dead:
                break
            nxt = self.moves[state].get(ch)
            if nxt is None:
                nxt = self.moves[state][ch] = self._step(state, ch)
            state = nxt
            stem = stem or self.ends[state][1]
        edits = self.ends[state][0]
        if edits == 0:
            return "words", 0
        if stem:
            return "stems", 0
        return ("fuzzy", edits) if edits is not None else None

    def hits(self, words: set[str]) -> dict:
        """The matching ones of a set of words."""
        if len(self.known) > MEMO:
            self.known = {}
        for w in words.difference(self.known):
            self.known[w] = self.match(w)
        return {w: m for w in words if (m := self.known[w])}


@lru_cache(maxsize=2)
def lexicon_of(words: tuple[str, ...], stems: tuple[str, ...]) -> Lexicon:
    """The lexicon's automaton, kept by a worker from task to task."""
    return Lexicon(list(words), list(stems))


def text_features(lexicon: Lexicon, text: str | None) -> list[float]:
    """Context-weighted sums of the hits, in the order of ``FEATURES``."""
    lower = (text or "").lower()
    tokens = _TOKEN.findall(lower)
    hits = lexicon.hits(set(tokens)) if tokens else {}
    sums = dict.fromkeys(FEATURES, 0.0)
    if hits:
        for m in _TOKEN.finditer(lower):
            if hit := hits.get(m[0]):
                around = lower[max(0, m.start() - WINDOW):m.end() + WINDOW]
                quoted = len(_QUOTE.findall(around))
                abuse = len(_ABUSE.findall(around))
                weight = (1 + 0.5 * min(abuse, 2)) / (1 + min(quoted, 2))
                sums["hits"] += weight
                sums["fuzzy"] += weight if hit[0] == "fuzzy" else 0
                sums["abuse"] += min(abuse, 2)
                sums["quoted"] += quoted > 0
        sums["rate"] = 100.0 * sums["hits"] / len(tokens)
    return [float(np.log1p(sums[k])) for k in FEATURES]


def copy_group(words: set[str]) -> int:
    """The same number for most near copies: the smallest word hashes under ``HASHES`` seeds."""
    return zlib.crc32(b"".join(min(zlib.crc32(w.encode(), k) for w in words).to_bytes(4, "little")
                               for k in range(HASHES)))


def learn_terms(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Words and stems that set toxic sample texts (text, toxic) apart."""

    def run(batches):
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"]):
                words = {w for w in _TOKEN.findall((text or "").lower()) if w.isalpha() and len(w) >= 4}
                if words:
                    terms = ["", *words, *{f"{w[:n]}*" for w in words for n in (4, 5) if len(w) > n}]
                    yield pd.DataFrame({"term": terms, "grp": copy_group(words), "toxic": int(toxic)})

    seen = sample.mapInPandas(run, "term string, grp long, toxic int").distinct()
    counts = written(seen.groupBy("term").agg(F.sum("toxic").alias("tox"), F.sum(1 - F.col("toxic")).alias("clean")),
                     "toxicity-terms")
    groups = counts.where("term = ''").first()  # every group holds the empty term
    if groups is None or not groups["tox"] or not groups["clean"]:
        return [], []
    n_tox, n_clean = groups["tox"], groups["clean"]
    ratio = ((F.col("tox") + 0.5) / (n_tox + 1)) / ((F.col("clean") + 0.5) / (n_clean + 1))
    # Of a bounded sample: at most as many terms as its texts hold.
    kept = counts.where((F.col("tox") >= max(3.0, MIN_SHARE * n_tox)) & (ratio >= MIN_RATIO) & (F.col("term") != ""))
    terms = sorted(r["term"] for r in kept.select("term").collect())
    return [t for t in terms if not t.endswith("*")], [t[:-1] for t in terms if t.endswith("*")]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (bias last) by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + np.diag(penalty), x.T @ (y - p) - penalty * w)
        w = w + step / max(1.0, np.abs(step).max() / 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", sample: int = SAMPLE) -> dict:
    """Lexicon and model from labelled rows where ``learn`` (on the label's id) holds."""
    known = labels.where(learn & col(label_col).isNotNull()).groupBy(col(id_col).alias("lid")).agg(
        F.max((col(label_col) > 0).cast("int")).alias("toxic"))
    known = written(known.withColumn("draw", F.xxhash64(F.lit("toxicity sample"), "lid")), "labels")
    picked = [known.where(F.col("toxic") == t).orderBy("draw", "lid").limit(sample) for t in (0, 1)]
    picked = written(picked[0].unionByName(picked[1]).select("lid", "toxic"), "label-sample")
    rows = written(docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
                   .join(picked, F.col("id") == F.col("lid")).select("text", "toxic"), "toxicity-sample")
    words, stems = learn_terms(rows)
    terms = tuple(words), tuple(stems)

    @F.pandas_udf("array<double>")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([text_features(lexicon_of(*terms), t) for t in text])

    sampled = sorted(rows.select("toxic", vector("text").alias("x")).collect())  # 2 * sample rows at most
    y = np.array([r["toxic"] for r in sampled], float)
    x = np.array([r["x"] for r in sampled], float).reshape(-1, len(FEATURES))
    if 0 < y.sum() < len(y):
        weights = logistic(x, y)
    else:
        weights = np.r_[np.zeros(len(FEATURES)), 30.0 if len(y) and y.all() else -30.0]
    return {"words": words, "stems": stems, "weights": weights}


def scored(docs: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """``docs`` with score added as the last column."""
    terms, weights = (tuple(model["words"]), tuple(model["stems"])), model["weights"]

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        x = np.array([text_features(lexicon_of(*terms), t) for t in text]).reshape(-1, len(FEATURES))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    n_score, = free(docs, "score")
    return docs.withColumn(n_score, score(col(text_col)))


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    part = F.crc32(F.col("doc_id").cast("string")) % 5
    model = fit(docs, table(spark, sf_dir, "labels"), part != 0)
    out = scored(docs, model)
    return out.select("doc_id", F.coalesce(part == 0, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
