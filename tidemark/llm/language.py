"""Language identification by Bayesian fusion of evidence.

For every language: the likelihood of the text's character trigrams, of the language that the markup declares, of
the address's suffix, and a prior from the host. Priors are smoothed down a hierarchy, host to registered domain to
corpus, from the text's soft decisions summed by grouped aggregation over all rows; a row's own decision is taken
out of its host's sums. How far declarations and suffixes can be trusted is counted the same way.

Every language that a row is labelled with is a candidate. The trigram model is fitted on an equal part of
``TRAIN_ROWS`` for each (``LEAST_ROWS`` at least), in the order of the ids' hashes, by their whole
texts; all else covers all rows. Defined results: a null, empty or very short text has little or no likelihood and is decided
by the other evidence, or by the corpus's prior; missing declarations, suffixes and hosts say nothing; ties go to
the first language by name; repeated rows are decided one by one; without labelled rows every language is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import saved, table
from tidemark.llm.encode import strings

TRAIN_ROWS, CELLS, SLICE = 4_000, 1 << 16, 1 << 20
#: A language's part of the training rows, where there are many languages.
LEAST_ROWS = 50
#: Neighbouring trigrams are not independent: their log-likelihoods count by this part.
TEMPER = 0.25
#: Rows that a parent's prior counts as, and the smoothing of declarations and suffixes.
STRENGTH, SMOOTH = 20.0, 0.5
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def cells(text: str) -> np.ndarray:
    """Hashed byte trigrams of the text, white space as single blanks."""
    raw = np.frombuffer(b" " + b" ".join(text.encode().translate(LOWER).split()) + b" ", np.uint8).astype(np.uint32)
    return ((raw[:-2] * 7919 + raw[1:-1]) * 7919 + raw[2:]) * np.uint32(2654435761) >> np.uint32(16) if len(raw) > 2 else np.zeros(0, np.uint32)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, cell, n) of texts (lang, text)."""
    for batch in batches:
        sums: dict[str, np.ndarray] = {}
        for lang, text in zip(batch.column(0).to_pylist(), strings(batch.column(1)).to_pylist(), strict=True):
            sums[lang] = sums.get(lang, 0) + np.bincount(cells(text), minlength=CELLS)
        for lang, n in sums.items():
            there = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(there), pa.string()), pa.array(there, pa.int32()), pa.array(n[there], pa.int64())], names=["lang", "cell", "n"])


def fitted(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities [CELLS, languages]) from labelled (doc_id, text, lang)."""
    known = labelled.where("lang IS NOT NULL").select(F.xxhash64("doc_id").alias("h"), "text", "lang")
    count = {r.lang: r["count"] for r in known.groupBy("lang").count().collect()}
    if not count:
        return [], np.zeros((CELLS, 0), np.float32)
    most = max(LEAST_ROWS, TRAIN_ROWS // len(count))
    cut = {name: min((1 << 63) - 1, int(-(1 << 63) + min(1.0, 1.5 * most / n) * (1 << 64))) for name, n in count.items()}
    some = known.where(F.col("h") <= F.element_at(F.create_map(*[F.lit(x) for item in cut.items() for x in item]), F.col("lang")))
    rows = some.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))).where(F.col("k") <= most).select("lang", "text")
    rows = saved(rows, "training")
    lost = sorted(count.keys() - {r.lang for r in rows.select("lang").distinct().collect()})  # ids that repeat can all lie behind the cut
    if lost:
        rows = rows.union(known.where(F.col("lang").isin(lost)).groupBy("lang").agg(F.min(F.struct("h", "text")).alias("x")).select("lang", "x.text"))
    names = sorted(count)
    counts = np.full((CELLS, len(names)), 0.5)
    for r in rows.mapInArrow(counted, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toLocalIterator():  # CELLS a language at most
        counts[r.cell, names.index(r.lang)] += r.n
    return names, np.log(counts / counts.sum(0)).astype(np.float32)


def likelihoods(rows: DataFrame, model: np.ndarray, text: str = "text") -> DataFrame:
    """rows with ``ll`` in place of the text: tempered log-likelihoods of the languages."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # CELLS x languages
    names = [c for c in rows.columns if c not in (text, "ll")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        for batch in batches:
            *rest, body = batch.columns
            out = np.zeros((batch.num_rows, table_.shape[1]))
            for i, t in enumerate(strings(body).to_pylist()):
                at = cells(t)
                for k in range(0, len(at), SLICE):
                    out[i] += table_[at[k : k + SLICE]].sum(0)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * table_.shape[1]), pa.array((out * TEMPER).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*rest, flat], names=[*names, "ll"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in names), "ll array<double>"])
    return rows.select(*names, text).mapInArrow(run, schema)


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores) if len(scores) > 1 else scores[0]
    parts = [F.exp(s - top) for s in scores]
    return [p / sum(parts[1:], parts[0]) for p in parts]


def fused(rows: DataFrame, languages: list[str]) -> DataFrame:
    """rows (ll, host, domain, declared, suffix, ...) with ``lang`` and ``confidence``, in place of columns so named."""
    k, names = len(languages), [c for c in rows.columns if c not in ("ll", "lang", "confidence")]
    if not k:
        return rows.select(*names, F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("confidence"))
    # the columns of the caller travel in one, as theirs could be named like those made here
    rows = rows.select("ll", "host", "domain", "declared", "suffix", F.struct(*names).alias("row"))
    soft = saved(rows.select("*", *[p.alias(f"p{i}") for i, p in enumerate(softmax([F.col("ll")[i] for i in range(k)]))]), "soft")
    sums = lambda df, *by: df.groupBy(*by).agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)])
    hosts = saved(sums(soft.where("host IS NOT NULL"), "host", "domain"), "hosts")
    domains = sums(hosts.where("domain IS NOT NULL"), "domain").withColumnsRenamed({"domain": "d_name", **{f"p{i}": f"d{i}" for i in range(k)}})
    whole = soft.agg(*[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]).first()
    total = sum(x or 0.0 for x in whole)
    prior = [((x or 0.0) + 1.0) / (total + k) for x in whole]
    d_total = sum((F.coalesce(f"d{i}", F.lit(0.0)) for i in range(k)), F.lit(0.0))
    priors = hosts.join(domains, F.col("domain") == F.col("d_name"), "left").select(
        F.col("host").alias("h_name"), F.col("domain").alias("h_domain"), *[F.col(f"p{i}").alias(f"h{i}") for i in range(k)],
        *[((F.coalesce(f"d{i}", F.lit(0.0)) + STRENGTH * prior[i]) / (d_total + STRENGTH)).alias(f"q{i}") for i in range(k)],
    )

    def trusted(column: str, mark: str) -> DataFrame:
        seen = sums(soft.where(F.col(column).isNotNull()), column)
        all_ = seen.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"p{i}").alias(f"p{i}") for i in range(k)]).first()
        return seen.select(F.col(column).alias(f"{mark}_name"), *[F.log((F.col(f"p{i}") + SMOOTH) / ((all_[f"p{i}"] or 0.0) + SMOOTH * (all_["n"] + 1))).alias(f"{mark}{i}") for i in range(k)])

    declared, suffix = trusted("declared", "m"), trusted("suffix", "s")
    all_rows = (
        soft.join(priors, (F.col("host") == F.col("h_name")) & F.col("domain").eqNullSafe(F.col("h_domain")), "left")
        .join(declared, F.col("declared") == F.col("m_name"), "left")
        .join(suffix, F.col("suffix") == F.col("s_name"), "left")
    )
    h_total = sum((F.greatest(F.col(f"h{i}") - F.col(f"p{i}"), F.lit(0.0)) for i in range(k)), F.lit(0.0))
    scores = []
    for i in range(k):
        own = F.greatest(F.col(f"h{i}") - F.col(f"p{i}"), F.lit(0.0))
        host = F.coalesce(F.log((own + STRENGTH * F.col(f"q{i}")) / (h_total + STRENGTH)), F.lit(float(np.log(prior[i]))))
        scores.append(F.col("ll")[i] + host + F.coalesce(f"m{i}", F.lit(0.0)) + F.coalesce(f"s{i}", F.lit(0.0)))
    scored = all_rows.select("row", *[s.alias(f"x{i}") for i, s in enumerate(scores)])
    best = F.greatest(*[F.struct(p.alias("p"), F.lit(-i).alias("i")) for i, p in enumerate(softmax([F.col(f"x{i}") for i in range(k)]))]) if k > 1 else F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("i"))
    return scored.select("row", best.alias("best")).select("row.*", F.element_at(F.array(*[F.lit(x) for x in languages]), 1 - F.col("best.i")).alias("lang"), F.round("best.p", 6).alias("confidence"))


def page_evidence(pages: DataFrame) -> DataFrame:
    """(doc_id null, page_id, text, declared, suffix, host, domain) of raw web pages."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    text = F.regexp_replace("html", r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    text = F.regexp_replace(text, r"&[#A-Za-z0-9]{1,10};", " ")
    declared = F.regexp_extract(F.lower("html"), r"""<html\b[^>]*?\blang\s*=\s*["']?([a-z]+)""", 1)
    empty = lambda c: F.when(c != "", c)
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), "page_id", text.alias("text"), empty(declared).alias("declared"),
        empty(F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1)).alias("suffix"), empty(host).alias("host"), empty(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
    )


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, with all their evidence, and all documents, with their text and their source as host."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    languages, model = fitted(docs)
    none = F.lit(None).cast("string")
    plain = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", none.alias("declared"), none.alias("suffix"), F.col("source").alias("host"), none.alias("domain"))
    rows = page_evidence(table(spark, sf_dir, "pages")).unionByName(plain)
    return fused(likelihoods(rows, model), languages).select("doc_id", "page_id", "lang", "confidence", "declared", "suffix", "host")
