"""Embedding hook (X6) and the vector-index sink / source.

The embedder is pluggable: any picklable callable ``list[str] -> ndarray``
(n x dim).  It runs inside an iterator Pandas UDF, called in sub-batches of
``batch_size`` texts like a remote embedding API would be, and the returned
count is checked against the submitted count.  The offline default is a
deterministic feature-hashing embedder (no model, no network).
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ordersight.functions.text import pad_number
from ordersight.session import bounded_batches

Embedder = Callable[[list[str]], np.ndarray]

# Fixed values of the index contract.
EMBEDDING_BATCH_SIZE = 64
INDEX_SCHEMA_VERSION = 1
DEFAULT_MODEL = "hashing-64"
_TOKEN = re.compile(r"\w+")


class HashingEmbedder:
    """Signed feature hashing of lower-cased word tokens, length 1.

    A token's number is the first 8 hex digits of its MD5; bucket and sign are
    read off it, and the components are integers over one square root, so any
    engine with MD5 gets the same vector."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.model = f"hashing-{dim}"

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), dtype=np.float64)
        cache: dict[str, int] = {}          # prose repeats words: hash each once per call
        for i, t in enumerate(texts):
            counts = Counter(_TOKEN.findall((t or "").lower()))
            if not counts:
                continue
            h = np.fromiter((cache[w] if w in cache else cache.setdefault(
                w, int(hashlib.md5(w.encode("utf-8")).hexdigest()[:8], 16)) for w in counts),
                dtype=np.int64, count=len(counts))
            weights = np.fromiter(counts.values(), dtype=np.float64, count=len(counts))
            weights *= np.where((h // self.dim) % 2 == 1, 1.0, -1.0)
            out[i] = np.bincount(h % self.dim, weights=weights, minlength=self.dim)
        norms = np.sqrt((out * out).sum(axis=1, keepdims=True))
        np.divide(out, norms, out=out, where=norms > 0)
        return out


def embedding_input_text(title: Column, section: Column, text: Column) -> Column:
    """The text that is embedded for a chunk."""
    return F.concat(F.lit("Document: "), title, F.lit("\nSection: "), section, F.lit("\n\n"), text)


def chunk_order(chunks: DataFrame) -> Column:
    """Text key that sorts chunks by document and number: the order of an index, and so of its ties."""
    return F.concat("document", F.lit("#"), pad_number(F.col("chunk_seq"), 9))


def embed_column(df: DataFrame, text_col: str, out_col: str = "embedding",
                 embedder: Embedder | None = None, batch_size: int = EMBEDDING_BATCH_SIZE) -> DataFrame:
    """Append an ``array<double>`` embedding of ``text_col``."""
    emb = embedder or HashingEmbedder()
    bounded_batches(df.sparkSession)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            texts = s.fillna("").tolist()
            vecs: list[np.ndarray] = []
            for off in range(0, len(texts), batch_size):
                part = texts[off: off + batch_size]
                got = np.asarray(emb(part), dtype=np.float64)
                if got.shape[0] != len(part):
                    raise RuntimeError("Embedding response count did not match submitted chunks.")
                vecs.extend(got)
            yield pd.Series(vecs, dtype=object)

    return df.withColumn(out_col, _embed(F.col(text_col)))


def index_rows(chunks: DataFrame, embedder: Embedder | None = None, model: str | None = None,
               documents: DataFrame | None = None) -> DataFrame:
    """Chunks + embedding + index metadata columns.  ``documents``: the loaded documents, counted inside the
    plan (without them, those that have a chunk)."""
    emb = embedder or HashingEmbedder()
    model = model or getattr(emb, "model", DEFAULT_MODEL)
    text = embedding_input_text(F.col("document_title"), F.col("section"), F.col("text"))
    rows = embed_column(chunks.withColumn("_input", text), "_input", "embedding", emb).drop("_input")
    loaded = documents if documents is not None else chunks.select("document").distinct()
    return rows.select(F.lit(INDEX_SCHEMA_VERSION).alias("schema_version"), F.lit(model).alias("embedding_model"),
                       loaded.agg(F.count(F.lit(1))).scalar().alias("document_count"), *rows.columns)


def write_vector_index(index: DataFrame, base_path: str, version: str) -> str:
    """Write the index to a new versioned path (a job-level commit; readers
    switch to the new version only after it is complete)."""
    path = f"{base_path.rstrip('/')}/v={version}"
    index.withColumn("created_at", F.current_timestamp()).write.mode("errorifexists").parquet(path)
    return path


def _file_system(spark, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def _put(spark, path: str, text: str) -> None:
    """A small file, whole under its name or not there: written beside and renamed over what is there."""
    jvm, beside = spark._jvm, f"{path}.{uuid.uuid4().hex}"
    fs, jpath = _file_system(spark, beside)
    out = fs.create(jpath, False)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(jpath.toUri(), spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(jpath, jvm.org.apache.hadoop.fs.Path(path), options)


def _get(spark, path: str) -> str | None:
    fs, jpath = _file_system(spark, path)
    if not fs.exists(jpath):
        return None
    return "\n".join(r.value for r in spark.read.text(path).collect())  # a manifest of a few lines


def publish_vector_index(index: DataFrame, base_path: str, version: str | None = None) -> dict:
    """Write the index as a new version and switch readers over to it; returns the manifest.

    The rows go to ``v=<version>`` through the committer; then a manifest beside them says what they are
    (schema version, model, documents, chunks, path), and last the pointer ``CURRENT`` is replaced by rename.  A
    reader sees the old version or the new one, never a part, and one that began with the old version reads on:
    nothing is removed.  A job that dies before the rename leaves the pointer as it was."""
    spark, version = index.sparkSession, version or uuid.uuid4().hex
    base = base_path.rstrip("/")
    path = write_vector_index(index, base, version)
    rows = spark.read.parquet(path)
    meta = rows.groupBy("schema_version", "embedding_model", "document_count").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("created_at").cast("string").alias("created_at")).limit(2).collect()
    if len(meta) > 1:
        raise ValueError("An index has one schema version and one model.")
    known = meta[0].asDict() if meta else {"schema_version": INDEX_SCHEMA_VERSION, "embedding_model": None,
                                           "document_count": 0, "chunks": 0, "created_at": None}
    manifest = {"version": version, "path": f"v={version}", **known}
    _put(spark, f"{base}/manifest-{version}.json", json.dumps(manifest))
    _put(spark, f"{base}/CURRENT", version)
    return manifest


def vector_index_manifest(spark, base_path: str) -> dict:
    """The manifest of the version that readers are pointed to."""
    base = base_path.rstrip("/")
    version = _get(spark, f"{base}/CURRENT")
    text = _get(spark, f"{base}/manifest-{version}.json") if version else None
    if not text:
        raise FileNotFoundError("Policy vector index not found. Build it first.")
    return json.loads(text)


def open_vector_index(spark, base_path: str, model: str) -> DataFrame:
    """The current version of a published index, rejected unless its manifest and its rows have schema version
    1 and the expected embedding model."""
    manifest = vector_index_manifest(spark, base_path)
    if manifest["schema_version"] != INDEX_SCHEMA_VERSION or manifest["embedding_model"] != model:
        raise ValueError("Policy vector index is incompatible. Rebuild it.")
    return read_vector_index(spark, f"{base_path.rstrip('/')}/{manifest['path']}", model)


def read_vector_index(spark, path: str, model: str) -> DataFrame:
    """Read an index and reject it unless every row has schema version 1
    and the expected embedding model."""
    df = spark.read.parquet(path)
    required = {"schema_version", "embedding_model", "embedding"}
    if not required <= set(df.columns):
        raise ValueError("Policy vector index is incompatible. Rebuild it.")
    # Metadata columns only (the vectors' validity bits, not the vectors); NULL metadata is incompatible too.
    bad = df.filter(~F.col("schema_version").eqNullSafe(F.lit(INDEX_SCHEMA_VERSION))
                    | ~F.col("embedding_model").eqNullSafe(F.lit(model))).limit(1).count()
    if bad:
        raise ValueError("Policy vector index is incompatible. Rebuild it.")
    return df
