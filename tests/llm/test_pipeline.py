import os
import random

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402

from caseweave.llm.queries import ORACLES, QUERIES  # noqa: E402

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents with known fates: (kept ids, dropped ids) are in the names of the sources."""
    rng = random.Random(1)
    words = [f"{a}{b}{c}" for a in ("st", "m", "pr", "l") for b in ("on", "ar", "ing", "e") for c in ("", "ly", "tion", "s")]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    rows = [(i, prose(120), "en", "keep") for i in range(300)]
    rows += [(1000 + i, rows[i][1], "en", "copy") for i in range(10)]
    near = [rows[i][1].split(" ") for i in range(10, 20)]
    rows += [(1100 + i, " ".join([*w[:60], "edited", *w[61:]]), "en", "near") for i, w in enumerate(near)]
    rows += [(1200, "too short", "en", "short"), (1201, "", "en", "short"), (1202, None, "en", "short"), (1203, "same five words here again " * 10, "en", "short"), (1204, " ".join(f"{i}{i}" for i in range(30, 60)), "en", "noletter")]
    rows += [(1300 + i, prose(60) + " token=abcdefgh12345 " + prose(60), "en", "secret") for i in range(5)]
    path = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(*r, len(r[1]) if r[1] is not None else None) for r in rows], COLUMNS).write.parquet(f"file://{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"file://{path}/labels.parquet")
    return f"file://{path}", {r[0]: r for r in rows}


def test_stages(spark, folder):
    path, rows = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialise(stage(spark, docs, path), "t")
        if name != "packing":
            assert docs.columns == columns
        kept[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    of = lambda *sources: {i for i, r in rows.items() if r[3] in sources}
    assert set(kept["quality rules"]) == set(rows) - of("short")
    assert set(kept["language id"]) == set(rows) - of("short", "noletter")
    assert set(kept["simhash near-dedup"]) >= of("keep", "secret") and not set(kept["simhash near-dedup"]) & of("copy")
    assert len(set(kept["simhash near-dedup"]) & of("near")) <= 1
    assert sorted(kept["secret scans"]) == sorted(kept["simhash near-dedup"])
    assert set(kept["packing"]) == set(kept["secret scans"])
    whole = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert whole == {r.doc_id: r.doc_tokens for r in docs.collect()}


def test_secrets_are_masked(spark, folder):
    path, _ = folder
    docs = corpus_pipeline.secret_scan(spark, spark.read.parquet(f"{path}/documents.parquet"), path)
    texts = [r.text for r in docs.where("source = 'secret'").collect()]
    assert len(texts) == 5 and all("[SECRET]" in t and "abcdefgh" not in t for t in texts)


def test_empty_documents(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, path)
        assert docs.collect() == []


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
def test_names_and_run(spark):
    assert sorted(QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(QUERIES) and len(QUERIES) == 13
    assert set(ORACLES) <= set(QUERIES)
    assert corpus_pipeline.run(spark, DIR).count() > 0
