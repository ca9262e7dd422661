import __spark_entry__
import corpus_pipeline
import duckdb
from arcweave.llm import quality, queries
from arcweave.llm.common import table

SF = "/root/testdata/sf0.001"


def test_contract_columns(spark):
    want = {
        "op1_bpe": "doc_id n_tokens ids_sha256 decoded_sha256", "op3_jaccard": "doc_id n_shingles component_id", "op4_decontaminate": "doc_id n_words n_hit n_items items_sha256 contaminated",
        "op5_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score", "op6_secrets": "doc_id n_assign n_access n_hex base_sha256 spans", "op8_max_score": "query_id rank vec_id score",
        "op9_quality": "doc_id held_out score predicted", "op10_url_filter": "page_id host path rule verdict",
    }
    found = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 11))
    for name in ("op1_bpe", "op6_secrets", "op8_max_score", "op9_quality", "op10_url_filter"):
        assert set(want[name].split()) <= set(found[name](spark, SF).columns)
    assert set(__spark_entry__.queries()) >= {*found, "pipeline"}


def test_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    for name in ("op8_max_score", "op10_url_filter", "op4_decontaminate"):
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        want = con.sql(queries.oracle_sql()[name])
        assert sorted(want.columns) == columns
        assert sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(str(tuple(r[want.columns.index(c)] for c in columns)) for r in want.fetchall())


def test_pipeline(spark):
    docs = table(spark, SF, "documents")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["good_quality", "one_of_copies", "no_benchmarks", "secret_scan", "encode"]
    got = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(got) <= docs.count() and len({r.doc_id for r in got}) == len(got) and all(r.round_trip for r in got)


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, clashing columns, and no rows at all: against the stages' own rules, one after another."""
    good = [f"The {w} walks under the old tree. It is quiet there, and the river is near {w}." for w in ("fox", "cat", "hare", "stone", "owl", "mill")]
    bad = "Win!! $$$ | click | buy;now %%% " * 4
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    long = " ".join(g + f" And so it is on day {i} of spring." for i, g in enumerate(good * 5)) + " "
    secret = "token = 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(i, g + f" Number {i}.", "en", 5) for i, g in enumerate(good * 8)] + [(100 + i, bad + str(i), "en", 1) for i in range(12)]
    rows += [(300 + i, bad + f"{i} times $$$ | now", "en", 1) for i in range(60)]
    rows += [(200, good[0] + " " + item, "en", 5), (201, long + secret, None, 5), (201, long + secret, None, 5), (None, good[2] + " Nobody is there.", "de", 5), (202, None, "en", None), (203, "", "en", 0)]
    rows += [(204, " ".join(f"The river {chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)} walks quietly under the tree." for i in range(9_000)), "en", 5)]
    schema = "doc_id long, text string, lang string, n_chars int, id long, token string, _key string, component long"
    docs = spark.createDataFrame([(*r, 1, "t", "k", 7) for r in rows], schema)
    labels = spark.createDataFrame([(r[0], int(not r[1].startswith("Win")), 0) for r in rows if r[0] is not None and r[1] and r[0] % 7], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, item, "x"), (None, good[3], "x"), (2, None, "x")], "item_id long, text string, doc_id string")
    labels.write.parquet(str(tmp_path / "labels.parquet")), bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        steps[name] = docs.collect()
        assert docs.columns == schema.replace(" long", "").replace(" string", "").replace(" int", "").split(", ") or name == "encode"
    ids = {name: [r.doc_id for r in found] for name, found in steps.items()}
    first = ids["good_quality"]
    judged = quality.score(spark.createDataFrame([(*r, 1, "t", "k", 7) for r in rows], schema), labels).collect()
    assert sorted(map(str, first)) == sorted(str(r.doc_id) for r in judged if r.predicted) and 0 < len(first) < len(rows) and not set(range(340, 360)) & set(first)
    assert set(range(48)) <= set(first) and first.count(201) == 2 and None in first and {200, 204} <= set(first)
    second = ids["one_of_copies"]
    assert second.count(201) == 1 and len(second) == len(set(second)) and {None, 204, 200} <= set(second)
    near = lambda i: {j for j in range(48) if j % 6 == i}
    assert all(len(near(k) & set(second)) >= 1 for k in range(6))
    assert set(ids["no_benchmarks"]) == set(second) - {200} and second.count(None) == 1
    masked = {r.doc_id: r for r in steps["secret_scan"]}
    assert masked.keys() == set(ids["no_benchmarks"]) and masked[201].text == long + "token = [SECRET]" and masked[201].n_chars == len(masked[201].text)
    assert sorted(map(str, ids["encode"])) == sorted(map(str, masked)) and all(r.round_trip for r in steps["encode"])
    assert {202, 203} & set(first) == {202, 203} & set(second)
    none = corpus_pipeline.run(spark, _empty(spark, tmp_path))
    assert none.count() == 0


def _empty(spark, tmp_path):
    path = str(tmp_path / "none")
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars int"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{path}/{name}.parquet")
    return path
