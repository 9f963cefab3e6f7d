"""Every registered corpus query, the learned operators and the pipeline, on the smallest tables."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline
from compare import compare, database
from gatehouse.llm import chat_format, linear, mixing, toxicity
from gatehouse.llm.oracles import ORACLES
from gatehouse.llm.queries import QUERIES
from gatehouse.llm.tables import emptied
from gatehouse.session import stored

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    found = database(SF)
    for name in ("embeddings", "labels"):
        found.execute(f"CREATE OR REPLACE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return found


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_its_twin(spark, db, name):
    problem, _ = compare(spark, db, SF, name)
    assert problem is None


def test_all_operators_and_the_pipeline_are_registered():
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
    assert set(QUERIES) <= set(E.queries()) and "pipeline" in E.queries()


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_languages_are_told(spark):
    found = QUERIES["op2_language_id"](spark, SF).join(documents(spark).select("doc_id", "lang"), "doc_id")
    assert found.count() == documents(spark).count()
    right = found.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.95


def made_up(spark, n=240):
    """Texts in which two words tell the labels."""
    rng = np.random.default_rng(1)
    texts, labels = [], []
    for k in range(n):
        bad, poor = k % 4 == 0, k % 3 == 0
        words = [f"w{x}" for x in rng.integers(0, 300, 40)]
        words[3:3] = ["Grumble!"] * 2 if bad else []
        words[9:9] = ["zzz"] * 3 if poor else []
        texts.append((k, " ".join(words), "en"))
        labels.append((k, int(not poor), int(bad)))
    odd = [(1000, None, "en"), (1001, "", "en"), (None, "grumble", "en"), (1002, "grumble " * 30_000, "en")]
    docs = spark.createDataFrame(texts + odd, "doc_id long, text string, p_toxic string")
    table = spark.createDataFrame([*labels, (1000, 1, 0), (1001, None, 1), (None, 1, 1), (0, 1, 0)], "doc_id long, quality int, toxic int")
    return docs, table


def test_toxicity_chain(spark):
    docs, labels = made_up(spark)
    chain = toxicity.learn(docs, labels)
    found = docs.select("doc_id", "text", toxicity.toxicity_of(spark, F.col("text"), chain).alias("p")).collect()
    assert len(found) == docs.count()
    for r in found:
        if not r.text:
            assert tuple(r.p) == (0.0, 0.0, 0.0)
        elif r.doc_id is None or r.doc_id == 1002:
            assert r.p.toxic > 0.5
        else:
            assert (r.p.toxic > 0.5) == (r.doc_id % 4 == 0) and (r.p.low_quality > 0.5) == (r.doc_id % 3 == 0)
            assert (r.p.toxic_low_quality > 0.5) == (r.doc_id % 12 == 0)


def test_a_link_of_the_chain_sees_those_before(spark):
    docs, labels = made_up(spark)
    chain = toxicity.learn(docs, labels)
    assert [len(w) for w in chain.weights] == [len(chain.chosen) + 5 + 1 + k for k in range(3)]


def test_nothing_to_learn_from(spark):
    docs, _ = made_up(spark, 4)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    chain = toxicity.learn(docs, none)
    found = docs.select(toxicity.toxicity_of(spark, F.col("text"), chain).alias("p")).collect()
    assert all(0 <= x <= 1 for r in found for x in r.p)


def test_logistic_regression_finds_the_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] + 0.5)))).astype(float)
    assert np.allclose(linear.fit(x, y, ridge=1e-6), [2.0, -1.0, 0.0, 0.5], atol=0.25)


def test_features_count_words_and_beginnings():
    chosen = linear.choose(pa.array(["bad bad"] * 8 + ["good"] * 8), np.array([[1]] * 8 + [[0]] * 8))
    counts = linear.matrix(pa.array(["Bad, bad good", None, "", "BADLY"]), chosen)[:, : len(chosen)]
    # "bad" stands twice in the first text; as a word and, having but three bytes, without a beginning.
    assert sorted(counts[0])[-1] == pytest.approx(np.log(3)) and counts[3].sum() == 0
    assert counts[1:3].sum() == 0


def test_rates_meet_the_targets(spark):
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.3, 0.3, 0.3], 500)
    n = rng.integers(0, 400, 500)
    members = spark.createDataFrame([(int(t), q.tolist()) for t, q in zip(n, p, strict=True)], "tokens long, posterior array<double>")
    shares = [0.7, 0.2, 0.1]
    steps = mixing.fit_rates(members.repartition(3), shares)
    rate = mixing._rates(p, steps)
    assert (rate >= 0).all()
    assert np.allclose((rate * n) @ p / n.sum(), shares, atol=1e-4)
    # The projected steps of one process, all documents at once.
    there, plain = n @ p, np.ones(500)
    for _ in range(len(steps)):
        plain = np.maximum(0, plain - p @ (((plain * n) @ p - np.array(shares) * n.sum()) / there))
    assert np.allclose(plain, rate)


def test_the_column_of_rates_follows_the_steps(spark):
    p, steps = np.array([[0.2, 0.8], [1.0, 0.0], [0.0, 1.0]]), np.array([[0.5, -0.25], [1.5, 0.1], [-0.2, 0.3]])
    rows = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(p)], "k int, posterior array<double>")
    found = rows.select("k", mixing.rates_column(F.col("posterior"), steps).alias("rate")).orderBy("k").collect()
    assert np.allclose([r.rate for r in found], mixing._rates(p, steps))
    assert {r[0] for r in rows.select(mixing.rates_column(F.col("posterior"), steps[:0])).collect()} == {1.0}


def test_emptied_tables_free_their_disk(spark):
    first, second = (stored(spark.range(n).withColumn("x", F.lit("y")), "freed") for n in (1000, 0))
    files = first.inputFiles()
    emptied(first, second)
    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
    assert spark.read.parquet(files[0].rsplit("/", 1)[0]).count() == 0


def test_rates_of_an_empty_domain_and_of_nothing(spark):
    kind = "tokens long, posterior array<double>"
    members = spark.createDataFrame([(10, [1.0, 0.0]), (0, [1.0, 0.0])], kind)
    assert np.isfinite(mixing.fit_rates(members, [0.5, 0.5])).all()
    assert mixing.fit_rates(spark.createDataFrame([], kind), [0.5, 0.5]).shape == (0, 2)


def test_copies_follow_the_rates(spark):
    rows = spark.range(20_000).withColumn("rate", F.lit(1.3))
    copies = rows.select(mixing.copies_of(F.col("rate"), "id").alias("n")).groupBy("n").count().collect()
    assert {r.n for r in copies} == {1, 2} and abs(sum(r.n * r["count"] for r in copies) / 20_000 - 1.3) < 0.02


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, needs string"
RESULTS = "conv_id long, call_id string, turn long, content string"
SCHEMAS = "name string, param string, type string, required boolean"


def test_linked_calls(spark):
    calls = spark.createDataFrame(
        [
            (1, "a", 9, "t", '{"y": 1.50, "x": "q"}', None),
            (1, "b", 2, "t", '{"x": 3}', "a"),
            (1, "b", 3, "t", '{"x": "again"}', "a"),
            (1, "c", 1, "t", "[1]", "b"),
            (1, "d", 5, "u", "{}", "e"),
            (1, "e", 6, "u", '{"k": {"z": 1, "b": [true, null]}}', "d"),
            (1, "f", 7, "t", None, "d"),
            (1, None, 8, "t", '{"x": "1", "x": "2"}', None),
            (2, "a", 0, "t", '{"x": "s", "z": 1, "y": "two"}', "elsewhere"),
        ],
        CALLS,
    ).withColumn("step", F.lit("clash"))
    results = spark.createDataFrame([(1, "a", 0, "ok"), (1, "a", 1, "later"), (1, "zz", 3, "o"), (1, None, 3, None), (2, "a", 1, None)], RESULTS)
    schemas = spark.createDataFrame([("t", "x", "string", True), ("t", "y", "number", False)], SCHEMAS)
    found = {(r.conv_id, r.call_id, r.kind): (r.step, r.status, r.problems, r.message) for r in chat_format.linked_messages(calls, results, schemas).collect()}
    assert found == {
        (1, "a", "call"): (0, "linked", [], '{"arguments":{"x":"q","y":1.5},"id":"a","name":"t","type":"call"}'),
        (1, "a", "result"): (1, "linked", [], '{"content":"ok","id":"a","type":"result"}'),
        (1, "b", "call"): (2, "unanswered", ["type:x"], '{"arguments":{"x":3},"id":"b","name":"t","type":"call"}'),
        (1, "c", "call"): (4, "unanswered", ["arguments"], '{"id":"c","name":"t","type":"call"}'),
        (1, "d", "call"): (None, "circular", ["tool"], '{"arguments":{},"id":"d","name":"u","type":"call"}'),
        (1, "e", "call"): (None, "circular", ["tool"], '{"arguments":{"k":{"b":[true,null],"z":1}},"id":"e","name":"u","type":"call"}'),
        (1, "f", "call"): (None, "circular", ["missing:x"], '{"arguments":{},"id":"f","name":"t","type":"call"}'),
        (1, None, "call"): (0, "unanswered", ["arguments"], '{"name":"t","type":"call"}'),
        (1, "zz", "result"): (None, "orphan", [], '{"content":"o","id":"zz","type":"result"}'),
        (1, None, "result"): (None, "orphan", [], '{"content":"","type":"result"}'),
        (2, "a", "call"): (0, "linked", ["type:y", "unknown:z"], '{"arguments":{"x":"s","y":"two","z":1},"id":"a","name":"t","type":"call"}'),
        (2, "a", "result"): (1, "linked", [], '{"content":"","id":"a","type":"result"}'),
    }


def test_a_long_chain_of_needs(spark):
    rows = [(1, str(k), 0, "t", "{}", str(k - 1)) for k in range(100)]
    found = chat_format.linked_messages(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), spark.createDataFrame([], SCHEMAS))
    assert sorted((int(r.call_id), r.step) for r in found.collect()) == [(k, 2 * k) for k in range(100)]


def test_no_calls(spark):
    assert chat_format.linked_messages(*(spark.createDataFrame([], k) for k in (CALLS, RESULTS, SCHEMAS))).collect() == []


def test_chat_formatting_runs_no_python(spark):
    plan = QUERIES["op10_chat_formatting"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_pipeline_stage_by_stage(spark):
    docs = documents(spark)
    names = docs.columns
    odd = spark.createDataFrame(
        [(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5), (None, "a text without identifier", "en", "s", 3)], docs.schema
    )
    twin = docs.orderBy("doc_id").limit(3).withColumn("doc_id", F.col("doc_id") + 2 * 10**6)
    start = docs.union(odd).union(twin)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "ngram_jaccard_join", "suffix_array_dedup", "mixing", "sentencepiece"]

    told = stages["language_id"](spark, start, SF)
    assert told.columns == names
    lost = start.select("doc_id").exceptAll(told.select("doc_id")).collect()
    with_letter = docs.filter(F.col("text").rlike("\\p{L}")).count()
    assert told.count() == with_letter + 1 + 3 and {r[0] for r in lost} >= {10**6, 10**6 + 1}

    single = corpus_pipeline.finished(stages["ngram_jaccard_join"](spark, told, SF), "t")
    assert single.columns == names
    assert single.filter(f"doc_id >= {2 * 10**6}").count() == 0 and single.filter("doc_id IS NULL").count() == 1

    cut = corpus_pipeline.finished(stages["suffix_array_dedup"](spark, single, SF), "t")
    assert cut.columns == names and cut.count() == single.count() and cut.schema == single.schema
    assert cut.filter(F.char_length("text") != F.col("n_chars")).count() == 0

    mixed = corpus_pipeline.finished(stages["mixing"](spark, cut, SF), "t")
    assert mixed.columns == names and mixed.exceptAll(cut).select("doc_id").distinct().join(cut, "doc_id", "left_anti").count() == 0

    coded = stages["sentencepiece"](spark, mixed, SF).collect()
    assert len(coded) == mixed.count() and all(r.n_pieces == len(r.ids) for r in coded)


def test_near_duplicates_are_dropped_by_row(spark):
    """Rows that repeat an identifier: copies go, a text of its own stays."""
    texts = [" ".join(f"{x}{k}" for k in range(60)) for x in "abcde"]
    near = texts[1] + " end"
    rows = [(1, texts[0], "p")] * 3 + [(2, texts[1], "p"), (3, texts[1], "p"), (3, texts[2], "p"), (4, near, "p"), (4, near, "p")]
    rows += [(5, texts[3], "q"), (5, texts[3], "p"), (6, texts[3], "p"), (None, texts[0], "p"), (None, texts[0], "p"), (2, texts[4], "p")]
    docs = spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], documents(spark).schema)
    found = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    assert found.schema.names == docs.columns
    kept = sorted((r.doc_id or 0, texts.index(r.text), r.source) for r in found.collect())
    assert kept == [(0, 0, "p"), (0, 0, "p"), (1, 0, "p"), (2, 1, "p"), (2, 4, "p"), (3, 2, "p"), (5, 3, "p")]


def test_pipeline_carries_columns_of_any_name_and_type(spark):
    """Names that stages might use themselves, a name with a space, a map; and thousands of equal rows."""
    text = " ".join(f"word{k} and" for k in range(60))
    names = {"_rid": F.lit(7), "_found": F.lit("x"), "kept": F.lit(1), "my col": F.lit(2), "row": F.create_map(F.lit("a"), F.lit(1)), "missing": F.lit("m")}
    names |= {"member": F.lit(3), "rate": F.lit(4), "copies": F.lit(5), "others": F.lit(6), "rid": F.lit(8), "bytes.per`x": F.lit(9)}
    own = [F.col(c) for c in documents(spark).columns]
    docs = documents(spark).limit(40).select(*own, *(v.alias(k) for k, v in names.items()))
    same = spark.range(5000).select(F.lit(10**7).alias("doc_id"), F.lit(text).alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(len(text)).cast("long").alias("n_chars"), *(v.alias(k) for k, v in names.items()))
    start = corpus_pipeline.finished(docs.union(same), "t")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = corpus_pipeline.finished(stage(spark, start, SF), "t")
        assert found.columns == start.columns, name
        assert [f.dataType for f in found.schema.fields] == [f.dataType for f in start.schema.fields], name
        values = found.select(*(F.col(f"`{c.replace('`', '``')}`").cast("string") for c in names)).distinct().collect()
        assert len(values) == 1 and values[0][0] == "7", name
        left = found.filter(f"doc_id = {10**7}").count()
        assert left == (1 if name == "ngram_jaccard_join" else 5000) or (name == "mixing" and left > 0), name


def test_clean_documents_are_not_dropped_by_the_mix(spark):
    """Whatever the shares are: clean ones stay, others are never repeated on average."""
    assert mixing.targets(np.array([970.0, 28.0, 2.0]), [0.9, 0.08, 0.02], None, 0) == pytest.approx([970, 28, 2])
    assert mixing.targets(np.array([500.0, 300.0, 200.0]), [0.9, 0.08, 0.02], None, 0) == pytest.approx([900, 80, 20])
    assert mixing.targets(np.array([960.0, 0.0, 40.0]), [0.9, 0.08, 0.02], None, 0) == pytest.approx([960, 0, 960 / 45])
    assert mixing.targets(np.array([1.0, 3.0]), [0.5, 0.5], None, None) == pytest.approx([2, 2])


def test_pipeline_of_nothing(spark):
    docs = documents(spark).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0
