"""Language identification by hierarchical discrimination (operator 7).

A text is lower-cased, runs of non-letters become one space, and its hashed byte
n-grams (1 to 3) form a vector of square-rooted shares (length 1).  One-versus-
rest linear support vector machines choose the language family; inside a family
of several languages one-versus-one machines vote.  The score is the product of
the logistic margins of both decisions.

Fitting takes ``PER_LANGUAGE`` labelled rows of each language at most and
``MAX_SAMPLE`` in all, but one of each language at least; whole texts, chosen by
a hash of the id.  A language is learned if it has the share ``MIN_SHARE`` of the
labelled rows or more.  Prediction covers every row.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
without any labelled row every text is ``und``; a language outside ``FAMILIES``
is a family of its own; a null id is never learned from and not held out; equal
texts get equal predictions; extra columns stay, added ones get a leading
underscore if they clash; very long texts are counted in slices.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ordersight.llm.common import bounded_batches, col, free, table, written

DIM = 4096
PER_LANGUAGE = 400
MAX_SAMPLE = 1600
MIN_SHARE = 0.001
#: The pipeline stage rejects texts whose best language scores below this: no machine takes them for its own.
REJECT = 0.02
SLICE = 1 << 20
#: Margins are multiplied by this before the logistic function.
SHARPNESS = 4.0
UND = "und"
#: Families of close languages (fixed values).
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "ar he mt",
    "sinitic": "yue zh",
    "austronesian": "id jv ms tl",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_GAP = re.compile(r"[\W\d_]+")
_LETTER = re.compile(r"[^\W\d_]")


def features(text: str) -> np.ndarray:
    """Square roots of the n-gram shares by hash bucket, length 1 (all zero without a letter)."""
    data = _GAP.sub(" ", text.lower()).strip().encode("utf-8")
    counts = np.zeros(DIM)
    if data:
        data = b" " + data + b" "
        for at in range(0, len(data), SLICE):
            b = np.frombuffer(data, np.uint8, min(SLICE + 2, len(data) - at), at).astype(np.uint32)
            for n in (1, 2, 3):
                if len(b) >= n:
                    h = np.full(len(b) - n + 1, n, np.uint32)
                    for k in range(n):
                        h = (h ^ b[k:len(b) - n + 1 + k]) * np.uint32(0x9E3779B1)
                        h ^= h >> np.uint32(15)
                    counts += np.bincount(h[:SLICE] & np.uint32(DIM - 1), minlength=DIM)
    total = counts.sum()
    return np.sqrt(counts / total) if total else counts


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 50.0, steps: int = 150) -> np.ndarray:
    """Weights (bias last) of a linear SVM with squared hinge loss, y in {-1, 1}: accelerated gradient descent."""
    y = y.astype(x.dtype)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1)).astype(x.dtype) * len(y)
    # The bias is the weight of a constant feature 1.
    rows = lambda w: x @ w[:-1] + w[-1]
    back = lambda r: np.append(r @ x, r.sum())
    v = np.ones(x.shape[1] + 1, x.dtype)
    for _ in range(15):  # largest eigenvalue, for the step size
        v = back(weight * rows(v))
        size = float(np.linalg.norm(v))
        v /= size
    step = x.dtype.type(1.0 / (1.0 + 2 * c * size / len(y) * 1.05))
    w = np.zeros(x.shape[1] + 1, x.dtype)
    look, t = w.copy(), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * rows(look))
        grad = look - x.dtype.type(2 * c / len(y)) * back(weight * slack * y)
        new, t_new = look - step * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + x.dtype.type((t - 1) / t_new) * (new - w), new, t_new
    return w.astype(np.float64)


def train(x: np.ndarray, langs: list[str]) -> dict:
    """Model of two levels from feature rows and their languages."""
    langs = np.array(langs, dtype=object)
    family_of = {lang: _FAMILY.get(lang, f"={lang}") for lang in sorted(set(langs))}
    families = sorted(set(family_of.values()))
    fam = np.array([family_of[lang] for lang in langs], dtype=object)
    model = {"families": families, "members": {f: [k for k, v in family_of.items() if v == f] for f in families}}
    model["top"] = (np.array([linear_svm(x, np.where(fam == f, 1.0, -1.0)) for f in families]).T
                    if len(families) > 1 else np.zeros((DIM + 1, 1)))
    pairs, weights = [], []
    for f in families:
        m = model["members"][f]
        for i in range(len(m)):
            for j in range(i + 1, len(m)):
                rows = (langs == m[i]) | (langs == m[j])
                pairs.append((m[i], m[j]))
                weights.append(linear_svm(x[rows], np.where(langs[rows] == m[i], 1.0, -1.0)))
    model["pairs"] = pairs
    model["low"] = np.array(weights).T if weights else np.zeros((DIM + 1, 0))
    return model


def predict(model: dict | None, text: str | None) -> tuple[str, float]:
    """(language, score) of one text."""
    if model is None or not text or not _LETTER.search(text):
        return UND, 0.0
    x = features(text)
    sure = lambda m: float(1 / (1 + np.exp(-SHARPNESS * np.clip(m, -50, 50))))
    top = x @ model["top"][:-1] + model["top"][-1]
    best = int(np.argmax(top))
    members = model["members"][model["families"][best]]
    score = sure(top[best]) if len(model["families"]) > 1 else 1.0
    if len(members) == 1:
        return members[0], score
    low = x @ model["low"][:-1] + model["low"][-1]
    votes = {m: [] for m in members}
    for (a, b), margin in zip(model["pairs"], low):
        if a in votes:
            votes[a].append(sure(margin))
            votes[b].append(sure(-margin))
    lang = max(members, key=lambda m: (sum(v > 0.5 for v in votes[m]), sum(votes[m]), m))
    return lang, score * min(votes[lang])


def fit(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, max_sample: int = MAX_SAMPLE, min_share: float = MIN_SHARE) -> dict | None:
    """Fit on a bounded sample of the rows where ``learn`` holds."""
    rows = docs.where(learn & col(lang_col).isNotNull() & col(text_col).rlike(r"\p{L}")).select(
        col(id_col).alias("id"), col(lang_col).alias("lang"), col(text_col).alias("text"))
    found = written(rows.groupBy("lang").count(), "languages")
    least = F.lit(min_share) * found.agg(F.sum("count")).scalar()
    counts = {r["lang"]: r["count"] for r in found.where(F.col("count") >= least).collect()}  # 1 / min_share rows at most
    if not counts:
        return None
    each = max(1, min(per_language, max_sample // len(counts)))
    share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, 1.5 * (each + 10) / n)))])
    draw = F.pmod(F.xxhash64(F.lit("language sample"), "id"), F.lit(1 << 20)) / float(1 << 20)
    picked = rows.where(draw < F.coalesce(share[F.col("lang")], F.lit(0.0)))
    order = Window.partitionBy("lang").orderBy(F.xxhash64(F.lit("language sample"), "id"), "id")
    picked = picked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= each)

    @F.pandas_udf("binary")
    def vector(text: pd.Series) -> pd.Series:
        return pd.Series([features(t).astype(np.float32).tobytes() for t in text])

    sample = picked.orderBy("lang", "rank").select("lang", vector("text").alias("x")).collect()
    x = np.frombuffer(b"".join(r["x"] for r in sample), np.float32).reshape(len(sample), DIM)
    return train(x, [r["lang"] for r in sample])


def predicted(docs: DataFrame, model: dict | None, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score added as the last columns."""

    @F.pandas_udf("lang string, score double")
    def guess(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([predict(model, t) for t in text], columns=["lang", "score"])

    n_lang, n_score, n_both = free(docs, "lang_pred", "score", "guess")
    out = docs.withColumn(n_both, guess(col(text_col)))
    return out.select(*[col(c) for c in docs.columns], F.col(n_both)["lang"].alias(n_lang),
                      F.col(n_both)["score"].alias(n_score))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 3 == 1, F.lit(False))


def learnable(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(col(id_col).cast("string")) % 3 != 1, F.lit(False))


def op7_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, learnable())
    out = predicted(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, model: dict | None, text_col: str = "text", reject: float = REJECT) -> DataFrame:
    """``docs`` without the texts that are in no language: those without a letter, and those whose best language
    scores below ``reject``.  Without a model (nothing to learn from) every text with a letter stays."""
    if model is None:
        return docs.where(F.coalesce(col(text_col).rlike(r"\p{L}"), F.lit(False)))
    out = predicted(docs, model, text_col)
    lang, score = out.columns[len(docs.columns):]
    return out.where((col(lang) != UND) & (col(score) >= reject)).select(*[col(c) for c in docs.columns])


def stage(spark, docs, sf_dir):
    """Pipeline stage: documents in no language go; all others stay as they are."""
    bounded_batches(spark)
    return accepted(docs, fit(docs, learnable()))
