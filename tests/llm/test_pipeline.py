from collections import Counter, defaultdict

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from quire.llm import classifier
from tests.llm.test_ngram_join import brute
from tests.llm.test_packing import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(P.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_names_and_columns(spark, stages):
    assert len(P.STAGES) == 5
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    for made in stages[:-1]:
        assert dict(made.dtypes) == dict(documents.dtypes)


def test_quality(spark, stages):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    weights = classifier.train(docs, labels)
    scores = {r.doc_id: r.score for r in classifier.score(docs, weights).collect()}
    assert sorted(r.doc_id for r in stages[0].collect()) == sorted(i for i, s in scores.items() if s >= 0.3)
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    assert good <= {r.doc_id for r in stages[0].collect()}


def test_near_duplicates(stages):
    rows = [(r.doc_id, r.text) for r in stages[0].collect()]
    groups = brute(rows, 5, 80)
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted({c for _, c in groups.values()})


def test_private_data(stages):
    before, after = ({r.doc_id: r for r in s.collect()} for s in stages[1:3])
    assert before.keys() == after.keys()
    changed = [i for i in before if before[i].text != after[i].text]
    assert changed and all(after[i].n_chars == len(after[i].text) for i in changed)


def test_mixing(stages):
    before, after = stages[2].collect(), stages[3].collect()
    uses = Counter(after)
    assert set(uses) == set(before) and max(uses.values()) <= 2
    tokens = defaultdict(lambda: [0, 0])
    for r in before:
        tokens[r.source][0] += len((r.text or "").split())
    for r in after:
        tokens[r.source][1] += len((r.text or "").split())
    assert min(b / a for a, b in tokens.values() if a) == 1


def test_packing(stages):
    uses = Counter(r.doc_id for r in stages[3].collect())
    rows = stages[4].collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == uses
    check((r.bin_id, r.capacity, r.place, r.n_tokens) for r in rows if r.bin_id is not None)


def test_run_is_the_stages_in_order(spark, stages):
    key = lambda r: tuple(-1 if v is None else v for v in r)
    got = sorted((tuple(r) for r in P.run(spark, SF).select("doc_id", "piece", "first_token", "n_tokens").collect()), key=key)
    assert got == sorted((tuple(r) for r in stages[4].select("doc_id", "piece", "first_token", "n_tokens").collect()), key=key)


def test_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, epoch int"
    rows = [(1, None, None, None, None, "x", 1), (2, "", "en", "s", 0, None, 2), (2, "", "en", "s", 0, None, 2), (None, "a b c", "en", "s", 5, "x", 1), (5, "w " * 50000, "en", "s", 100000, "x", 1), (6, "b", None, None, None, "x", 1)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for name, stage in P.STAGES:
            made = stage(spark, docs, SF)
            n = made.count()
            assert (n > 0) == bool(docs.take(1)), name
            if name not in ("best-fit packing",):
                assert made.columns == list(P.COLUMNS)
