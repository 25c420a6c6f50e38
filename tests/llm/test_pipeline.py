import corpus_pipeline
import duckdb

from txloom.llm import registry
from txloom.llm.substring import OP8_SQL

SF = "/root/testdata/sf0.001"


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "toxicity", "ngram_jaccard_join", "substring_dedup", "packing"]
    texts = {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        step(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        rows = docs.collect()
        after = {r["doc_id"] for r in rows}
        assert after <= before and len(after) > 0.8 * len(before) and len(rows) == len(after)
        before, texts = after, {r["doc_id"]: r["text"] for r in rows}
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert {p["doc_id"] for p in pieces} == set(texts)
    again = corpus_pipeline.run(spark, SF).collect()
    key = lambda ps: sorted((p["doc_id"], p["start"], p["length"], p["ids_crc32"]) for p in ps)
    totals = lambda ps: sorted({(p["doc_id"], p["doc_tokens"]) for p in ps})
    assert totals(again) == totals(pieces) and sum(k[2] for k in key(again)) == sum(k[2] for k in key(pieces))


ODD = """doc_id long, text string, lang string, source string, n_chars long, kept string, n_words long, n_removed int, spans string, node long, label long, score double,
block string, key string, n int, toxic int, ids string"""


def odd_docs(spark):
    """Null ids, texts and languages, rows that repeat, one id with two texts, a long text, clashing names."""
    base = [r for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    extra = ("k", 1, 2, "s", 3, 4, 0.5, "b", "q", 7, 1, "i")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"], *extra) for r in base]
    rows += rows[:3] * 4 + [(rows[0][0], rows[1][1], *rows[0][2:]), (None, rows[2][1], None, None, None, *extra), (None, None, None, None, None, *[None] * 12)]
    rows += [(9_000_001, None, "en", "s", 0, *extra), (9_000_002, "", "en", "s", 0, *extra), (9_000_003, " ".join([rows[3][1]] * 40), "en", "s", 0, *extra)]
    return spark.createDataFrame(rows, ODD)


def test_stages_on_odd_rows_and_on_none(spark, tmp_path):
    docs = odd_docs(spark)
    for frame in (docs, docs.limit(0)):
        for name, step in corpus_pipeline.STAGES:
            out = step(spark, frame, SF)
            rows = out.collect()
            if name == "packing":
                assert {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)
                continue
            assert out.columns == frame.columns and out.schema.simpleString() == frame.schema.simpleString()
            assert len(rows) <= frame.count() and (name != "substring_dedup" or len(rows) == frame.count())
            assert all(r["kept"] in ("k", None) and r["spans"] in ("s", None) and r["n_words"] in (1, None) for r in rows)
    (tmp_path / "documents.parquet").mkdir()
    docs.limit(0).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/labels.parquet").limit(0).write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_oracles(spark):
    c = duckdb.connect()
    for t in ("documents", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name, sql in registry.ORACLES.items():
        want = c.sql(sql)
        got = registry.QUERIES[name](spark, SF)
        assert sorted(got.columns) == sorted(want.columns)
        assert sorted(map(repr, map(tuple, got.select(*want.columns).collect()))) == sorted(map(repr, want.fetchall())), name
    assert registry.ORACLES["op8_substring_dedup"] is OP8_SQL
