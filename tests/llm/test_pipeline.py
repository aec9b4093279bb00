import random

import corpus_pipeline
from scanloom.llm import bpe, secrets

from .helpers import DOCS, frame, rows, words


def documents():
    rng = random.Random(9)
    lang = {"en": ["the", "and", "ing", "th", "er"], "de": ["der", "und", "sch", "ich", "ein"]}
    make = lambda k, n: " ".join("".join(rng.choice(lang[k]) for _ in range(rng.randint(1, 4))) for _ in range(n))
    out = [(i, make("en" if i % 2 else "de", rng.randint(60, 300)), "en" if i % 2 else "de", "s", 0) for i in range(80)]
    copy = out[4][1]
    near = copy.split(" ")
    near[10] = "other"
    return [*out, (200, copy, "de", "s", 0), (201, " ".join(near), "de", "s", 0), (202, None, None, None, None), (203, "12 34 !!", None, "s", 0), (204, make("en", 80) + " password = hunter2000 " + make("en", 80), "en", "s", 0)]


def test_stages_one_by_one(spark, tmp_path):
    docs = spark.createDataFrame(documents(), DOCS)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_near_dedup", "secret_scan", "best_fit_packing"]
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != names[-1]:
            assert out.dtypes == docs.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append(docs)
    ids = [sorted(r["doc_id"] for r in d.select("doc_id").distinct().collect()) for d in seen]
    assert ids[0] == [*range(80), 200, 201, 204]
    assert ids[1] == ids[2] == ids[3] == [*range(80), 204]
    masked = {r["doc_id"]: r for r in seen[2].collect()}
    assert "[SECRET]" in masked[204]["text"] and masked[204]["n_chars"] == len(masked[204]["text"]) and not secrets.brute(masked[204]["text"])
    encoded = bpe.codec().encode_texts([masked[i]["text"] for i in ids[2]]).counts()
    total = {}
    for r in seen[3].collect():
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert total == {i: int(n) + 1 for i, n in zip(ids[2], encoded, strict=True)}


def test_run_gives_the_last_stage(spark, tmp_path):
    spark.createDataFrame(documents(), DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == 81


def test_stages_of_hard_rows_and_empty_tables(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows and further columns with clashing names; and no row at all."""
    hard = frame(spark, [*rows(), *((1000 + r[0], *r[1:]) for r in documents())]).selectExpr("*", "4 AS salt", "5 AS node", "6 AS found", "7 AS row", "8 AS lang_pred", "9 AS score")
    for data in (hard, hard.limit(0)):
        docs = data
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path)).cache()
            if name != "best_fit_packing":
                assert out.dtypes == docs.dtypes
            docs = out
        assert docs.where("length is null or sequence_id is null").count() == 0
        if data is hard:
            ids = {r["doc_id"] for r in docs.collect()}
            assert {5, 9} <= ids and not {7, 8} & ids  # copies go, short and long texts stay
        else:
            assert docs.count() == 0
