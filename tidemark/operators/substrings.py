"""Substring search through a table of trigrams.

``postings`` has a row for each trigram (lower case) of each text and its key, sorted by trigram, so that a search reads
only the row groups of its own; a text shorter than three characters is its own entry. ``counts`` has how many texts a
trigram has. A search takes the ``MOST`` rarest trigrams of its term, keeps the keys that have all of them, and looks for
the term in these texts alone. A trigram that a third of all texts have is cut over many files, as rows are dealt by
ranges of (trigram, key).

Texts are cut in pieces of ``PIECE`` characters that overlap, so work grows with a text's length.

Defined results: case is folded by lower(); a null text has no entry and is never found; an empty term is in every text
that isn't null; a term of one or two characters is looked for among the trigrams themselves; repeated keys are one
in the answer of the postings, and each of their rows is looked at.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAM, MOST = 3, 4
#: Characters of a text whose trigrams are made at a time. Spark finds a character by counting from the start.
PIECE = 4096


def pieces(text: Column) -> Column:
    """A text in lower case, cut so that each of its trigrams lies in a piece."""
    low = F.lower(text)
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(low), F.lit(1)), F.lit(PIECE)), lambda i: F.substr(low, i, F.lit(PIECE + GRAM - 1)))


def grams(piece: Column) -> Column:
    """Distinct trigrams; all of it, if it is shorter. The outer transform binds the characters once."""
    characters = F.regexp_extract_all(piece, F.lit("(?s)."), F.lit(0))
    several = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(c) - GRAM), lambda i: F.concat(*[c[i + k] for k in range(GRAM)])))
    return F.transform(F.array(characters), lambda c: F.when(F.size(c) < GRAM, F.array(F.array_join(c, ""))).otherwise(several(c)))[0]


class SubstringIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, texts: DataFrame, path: str, key: str, text: str = "text") -> SubstringIndex:
        out = cls(texts.sparkSession, path)
        out.append(texts, key, text, "overwrite")
        return out

    def append(self, texts: DataFrame, key: str, text: str = "text", mode: str = "append") -> None:
        """Adds texts; counts of several batches are added up where they are read."""
        cut = texts.where(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.explode(pieces(F.col(text))).alias("piece"))
        rows = cut.select("key", F.explode(grams(F.col("piece"))).alias("gram"))
        rows = rows.repartitionByRange("gram", "key").sortWithinPartitions("gram", "key")
        rows.write.mode(mode).options(**{"parquet.block.size": str(1 << 20)}).parquet(f"{self.path}/postings")
        batch = self.postings() if mode == "overwrite" else rows
        batch.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("gram").sortWithinPartitions("gram").write.mode(mode).parquet(f"{self.path}/counts")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def chosen(self, term: str) -> list[str]:
        """The rarest of the term's trigrams."""
        term = term.lower()
        own = sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})
        known = {r.gram: r.n for r in self.spark.read.parquet(f"{self.path}/counts").where(F.col("gram").isin(own)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # the term's own
        return sorted(own, key=lambda g: (known.get(g, 0), g))[:MOST]

    def candidates(self, term: str) -> DataFrame:
        """(key) of the texts that have all chosen trigrams; of a short term, of those with a trigram around it."""
        if len(term) < GRAM:
            return self.postings().where(F.contains("gram", F.lit(term.lower()))).select("key").distinct()
        own = self.chosen(term)
        return self.postings().where(F.col("gram").isin(own)).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(own)).select("key")

    def search(self, texts: DataFrame, term: str, key: str, text: str = "text") -> DataFrame:
        """The rows of texts (those that were indexed) with the term."""
        found = texts.where(F.contains(F.lower(text), F.lower(F.lit(term))))
        return found if not term else found.join(self.candidates(term).withColumnRenamed("key", key), key, "left_semi").select(texts.columns)

    def search_all(self, texts: DataFrame, terms: list[str], key: str, text: str = "text") -> DataFrame:
        """(term, key) of several terms."""
        return reduce(DataFrame.unionByName, [self.search(texts, t, key, text).select(F.lit(t).alias("term"), key) for t in terms])
