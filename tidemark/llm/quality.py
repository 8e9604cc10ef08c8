"""Quality rules whose cut-offs come from mergeable quantile sketches per language and source.

The sketch of a feature is a histogram over integer buckets with 6 significant bits, so a bucket is at most 1/32
of its value wide. Two sketches merge by adding counts: a (language, source) pair with fewer than ``min_group``
documents uses the merged sketch of its language, and a language with too few that of the whole corpus.
A document is an outlier if a feature lies beyond the quartiles by ``reach`` times the quartile distance; a
least distance for each feature keeps narrow groups from rejecting ordinary documents.

Defined results: null and blank texts have no words, so base_failed is true and kept false; null language or
source is a group of its own; rows that repeat are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, saved, staged, table, words_of

SYMBOLS = "#*$%&|<>"
#: Least quartile distance of each feature, in thousandths: characters a word, symbols a word, repeated lines
#: among lines, repeated words among words, capitals among characters, ASCII punctuation a word.
LEAST = {"f_chars": 1000, "f_symbols": 150, "f_lines": 150, "f_repeats": 100, "f_upper": 80, "f_marks": 300}
UPPER, MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
REACH, MIN_GROUP, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 3, 100, 20, 30, 8
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the base counts, the features in thousandths and base_failed."""
    raw, words, lines, hashes, wins = fresh(docs, "q_raw", "q_words", "q_lines", "q_hashes", "q_wins")
    at = ", ".join(f"{hashes}[i + {j}]" for j in range(WINDOW))
    repeats = f"""
        CASE WHEN n_words < {WINDOW} OR size(array_distinct({wins})) = size({wins}) THEN 0L
        ELSE aggregate(
            transform(array(array_sort(transform({wins}, (h, i) -> struct(h, i)))), s ->
                sort_array(transform(filter(s, (x, j) -> (j > 0 AND s[greatest(j - 1, 0)].h = x.h)
                    OR (j < size(s) - 1 AND s[least(j + 1, size(s) - 1)].h = x.h)), x -> x.i)))[0],
            named_struct('total', 0L, 'last', -{WINDOW}),
            (a, p) -> named_struct('total', a.total + least({WINDOW}, p - a.last), 'last', p),
            a -> a.total)
        END"""
    per = lambda top, below: F.expr(f"CASE WHEN {below} > 0 THEN {top} * 1000 DIV {below} ELSE 0L END")
    return (
        docs.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
        .withColumns({words: words_of(F.col(raw)), lines: F.filter(F.split(F.col(raw), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
        .withColumns({
            hashes: F.transform(words, lambda w: F.xxhash64(w)),
            "n_words": F.size(words).cast("long"),
            "word_chars": F.length(F.regexp_replace(raw, r"[\x20\x09-\x0D]+", "")).cast("long"),
            "n_symbols": (F.length(raw) - F.length(F.translate(raw, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
            "n_lines": F.size(lines).cast("long"),
            "n_upper": (F.length(raw) - F.length(F.translate(raw, UPPER, ""))).cast("long"),
            "n_marks": (F.length(raw) - F.length(F.translate(raw, MARKS, ""))).cast("long"),
        })
        .drop(raw, words, lines)
        .withColumn(wins, F.expr(f"CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, size({hashes}) - {WINDOW}), i -> xxhash64({at})) ELSE array() END"))
        .withColumn("n_repeat_words", F.expr(repeats))
        .drop(hashes, wins)
        .withColumn("base_failed", F.expr(f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))
        .withColumns({"f_chars": per("word_chars", "n_words"), "f_symbols": per("n_symbols", "n_words"), "f_lines": per("n_dup_lines", "n_lines"), "f_repeats": per("n_repeat_words", "n_words"), "f_upper": per("n_upper", "word_chars"), "f_marks": per("n_marks", "n_words")})
        .drop("n_lines", "n_upper", "n_marks")
    )


def sketch(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, feature, bucket, n): the mergeable sketch of every group, by one partial aggregation.

    Documents that fail the base rules are left out: they are rejected anyway and would bend the quartiles.
    """
    stacked = ", ".join(f"'{f}', {f}" for f in LEAST)
    return (
        features.where("NOT base_failed")
        .select(F.col(lang).alias("lang"), F.col(source).alias("source"), F.expr(f"stack({len(LEAST)}, {stacked}) AS (feature, v)"))
        .withColumn("e", F.expr("greatest(length(bin(v)) - 6, 0)"))
        .withColumn("bucket", F.expr("shiftleft(shiftright(v, e), e)"))
        .groupBy("lang", "source", "feature", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(sketches: DataFrame, reach: int = REACH, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, lo_*, hi_*): fences of every group, from its own, its language's or the corpus's sketch."""
    least = "CASE feature " + " ".join(f"WHEN '{k}' THEN {v}L" for k, v in LEAST.items()) + " END"
    columns = ", ".join(f"max(CASE WHEN feature = '{f}' THEN lo END) AS lo_{f[2:]}, max(CASE WHEN feature = '{f}' THEN hi END) AS hi_{f[2:]}" for f in LEAST)
    return sketches.sparkSession.sql(f"""
        WITH merged AS (
            SELECT 0 AS depth, lang, source, feature, bucket, n FROM {{sketches}}
            UNION ALL SELECT 1, lang, NULL, feature, bucket, sum(n) FROM {{sketches}} GROUP BY lang, feature, bucket
            UNION ALL SELECT 2, NULL, NULL, feature, bucket, sum(n) FROM {{sketches}} GROUP BY feature, bucket),
        ranked AS (
            SELECT *, sum(n) OVER (PARTITION BY depth, lang, source, feature ORDER BY bucket) AS upto,
                sum(n) OVER (PARTITION BY depth, lang, source, feature) AS total FROM merged),
        quartiles AS (
            SELECT depth, lang, source, feature, max(total) AS total,
                min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1,
                min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3
            FROM ranked GROUP BY depth, lang, source, feature),
        fences AS (
            SELECT depth, lang, source, feature, total,
                q1 - {reach} * greatest(q3 - q1, {least}) AS lo, q3 + {reach} * greatest(q3 - q1, {least}) AS hi
            FROM quartiles),
        wide AS (SELECT depth, lang, source, max(total) AS total, {columns} FROM fences GROUP BY depth, lang, source)
        SELECT g.lang, g.source, {", ".join(f"CASE WHEN g.total >= {min_group} THEN g.{s}_{f[2:]} WHEN l.total >= {min_group} THEN l.{s}_{f[2:]} ELSE c.{s}_{f[2:]} END AS {s}_{f[2:]}" for f in LEAST for s in ("lo", "hi"))}
        FROM wide g JOIN wide l ON l.depth = 1 AND g.lang <=> l.lang JOIN wide c ON c.depth = 2
        WHERE g.depth = 0""", sketches=sketches)


def with_verdict(features: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """measured() rows with kept. They are read twice, by the sketches and by the joined filter: pass a table."""
    # a table, whose size Spark knows: small fences are broadcast, and the texts beside the features stay in place
    fences = saved(thresholds(sketch(features, lang, source)).withColumnsRenamed({"lang": "t_lang", "source": "t_source"}), "fences")
    inside = " AND ".join(f"({f} BETWEEN lo_{f[2:]} AND hi_{f[2:]})" for f in LEAST)
    return (
        features.join(fences, features[lang].eqNullSafe(fences["t_lang"]) & features[source].eqNullSafe(fences["t_source"]), "left")
        .withColumn("kept", F.expr(f"NOT base_failed AND coalesce({inside}, true)"))
        .drop("t_lang", "t_source", *LEAST, *(f"{s}_{f[2:]}" for f in LEAST for s in ("lo", "hi")))
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return with_verdict(saved(measured(docs).drop("text"), "quality")).select("doc_id", *BASE, "base_failed", "kept")


@staged
def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with their own columns."""
    boxed = docs.select(F.struct(*docs.columns).alias("row"), "text", "lang", "source")
    return with_verdict(saved(measured(boxed).drop("text"), "quality")).where("kept").select("row.*")


def sql(words: str = r"list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '')") -> str:
    """The same rows in DuckDB's SQL."""
    least = "CASE feature " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in LEAST.items()) + " END"
    columns = ", ".join(f"max(CASE WHEN feature = '{f}' THEN {s} END) AS {s}_{f[2:]}" for f in LEAST for s in ("lo", "hi"))
    pick = lambda x: f"CASE WHEN g.total >= {MIN_GROUP} THEN g.{x} WHEN l.total >= {MIN_GROUP} THEN l.{x} ELSE c.{x} END"
    inside = " AND ".join(f"({f} BETWEEN {pick('lo_' + f[2:])} AND {pick('hi_' + f[2:])})" for f in LEAST)
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{f}' AS feature, {f} AS v FROM feats WHERE NOT base_failed" for f in LEAST)
    return f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
        w AS (SELECT r, {words} AS ws FROM d),
        l AS (SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
        grams AS (SELECT r, i, array_to_string(ws[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS i FROM w WHERE len(ws) >= {WINDOW})),
        twice AS (SELECT r, g FROM grams GROUP BY r, g HAVING count(*) > 1),
        covered AS (SELECT r, count(DISTINCT i + j) AS n FROM grams JOIN twice USING (r, g), range({WINDOW}) x(j) GROUP BY r),
        counts AS (
            SELECT d.*, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
                (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
                (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls) AS n_lines,
                length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, length(t) - length(regexp_replace(t, '[!-/:-@\\[-`{{-~]', '', 'g')) AS n_marks
            FROM d JOIN w USING (r) JOIN l USING (r) LEFT JOIN covered USING (r)),
        feats AS (
            SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
                CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS f_chars,
                CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS f_symbols,
                CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS f_lines,
                CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS f_repeats,
                CASE WHEN word_chars > 0 THEN n_upper * 1000 // word_chars ELSE 0 END AS f_upper,
                CASE WHEN n_words > 0 THEN n_marks * 1000 // n_words ELSE 0 END AS f_marks
            FROM counts),
        stacked AS ({stacked}),
        shifts AS (SELECT *, greatest(length(bin(v)) - 6, 0) AS e FROM stacked),
        cells AS (SELECT lang, source, feature, (v::BIGINT >> e) << e AS bucket, count(*) AS n FROM shifts GROUP BY ALL),
        merged AS (
            SELECT 0 AS depth, lang, source, feature, bucket, n FROM cells
            UNION ALL SELECT 1, lang, NULL, feature, bucket, sum(n) FROM cells GROUP BY lang, feature, bucket
            UNION ALL SELECT 2, NULL, NULL, feature, bucket, sum(n) FROM cells GROUP BY feature, bucket),
        ranked AS (
            SELECT *, sum(n) OVER (PARTITION BY depth, lang, source, feature ORDER BY bucket) AS upto,
                sum(n) OVER (PARTITION BY depth, lang, source, feature) AS total FROM merged),
        quartiles AS (
            SELECT depth, lang, source, feature, max(total) AS total, min(CASE WHEN upto * 4 >= total THEN bucket END) AS q1,
                min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS q3 FROM ranked GROUP BY depth, lang, source, feature),
        fences AS (SELECT *, q1 - {REACH} * greatest(q3 - q1, {least}) AS lo, q3 + {REACH} * greatest(q3 - q1, {least}) AS hi FROM quartiles),
        wide AS (SELECT depth, lang, source, max(total) AS total, {columns} FROM fences GROUP BY depth, lang, source)
        SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
            NOT f.base_failed AND coalesce({inside}, true) AS kept
        FROM feats f LEFT JOIN wide g ON g.depth = 0 AND f.lang IS NOT DISTINCT FROM g.lang AND f.source IS NOT DISTINCT FROM g.source
            LEFT JOIN wide l ON l.depth = 1 AND f.lang IS NOT DISTINCT FROM l.lang LEFT JOIN wide c ON c.depth = 2"""
