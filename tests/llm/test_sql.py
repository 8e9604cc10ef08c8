"""The operators that SQL can express, against DuckDB on the small tables and on odd documents."""

import duckdb
import pytest

from tidemark.llm import licenses
from tidemark.llm.queries import ORACLES, QUERIES

#: In paragraphs, as it is usually printed.
MIT = "MIT License\n\n" + licenses.TEMPLATES["MIT"].replace(" The above", "\n\nThe above").replace(" THE SOFTWARE IS", "\n\nTHE SOFTWARE IS")
SF = "/root/testdata/sf0.001"
ODD = [
    (1, None, None, None), (2, "", "en", "s"), (3, " \n\t ", "en", "s"), (None, "no id", "en", "s"), (4, "Licensed under CC BY-NC 4.0.\nmore\nlines", "en", "t"), (4, "Licensed under CC BY-NC 4.0.\nmore\nlines", "en", "t"),
    (5, "a b c d e f g h " * 3000, "de", "t"), (6, "All rights reserved.\n\nnext\nblock", "fr", None), (7, "# * $ %\n" * 30, "en", "t"), (8, "one two three four five six seven eight nine ten eleven", "en", "s"),
]


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    odd = tmp_path_factory.mktemp("odd")
    spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in ODD], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{odd}/documents.parquet")
    spark.createDataFrame([("x", "Two three four FIVE, six seven eight nine ten eleven"), ("y", "no id"), ("z", None), ("x", "eight nine"), (None, "block next"), (None, " ".join(["a b c d"] * 5))], "item_id string, text string").coalesce(1).write.parquet(f"{odd}/benchmark.parquet")
    turns = [(i % 7, i // 3 if i % 5 else None, ["user", "assistant", "tool", None][i % 4], ["Yes.", "no", " ", None, "What?\n"][i % 5]) for i in range(90)] + [(None, 1, "user", "x.")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{odd}/conversations.parquet")
    vectors = [(i, [float((i * j) % 11) / 3 for j in range(64)]) for i in range(60)] + [(5, [0.5] * 64), (None, [1.0] * 64), (70, None), (71, [1.0]), (72, [float("nan")] * 64), (73, [None] * 64)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{odd}/embeddings.parquet")
    return {"small": (SF, SF + "/{}.parquet"), "odd": (str(odd), f"{odd}/{{}}.parquet/*.parquet")}


@pytest.mark.parametrize("which", ["small", "odd"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, folders, name, which):
    folder, path = folders[which]
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path.format(t)}'")
    got, want = QUERIES[name](spark, folder), con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want.select(*columns).fetchall()))
