"""The pipeline's stages against the operators' brute force on a small table."""

from collections import defaultdict

import corpus_pipeline
from pyspark.sql import functions as F
from tabulant.llm import packing
from tests.llm import cases
from tests.llm.test_corpus_models import brute_components
from tests.llm.test_exact_and_pages import norm


def test_stages_and_run(spark, tmp_path):
    docs = cases.frame(spark).select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality_rules", "exact_dedup", "ngram_jaccard_join", "mixing", "packing"]
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append([tuple(r) for r in now.collect()])
        if name != "packing":
            assert now.columns == docs.columns
    judged, exact, near, mixed, packed = seen
    assert 0 < len(exact) < len(judged) and len({norm(r[1]) for r in judged}) == len(exact)
    want = [i for i, _, c in brute_components([r[:2] for r in exact], 5, 80, 100) if i is None or i == c]
    assert sorted(str(r[0]) for r in near) == sorted(map(str, want))
    assert sorted(map(str, mixed)) == sorted(map(str, near))
    assert {r[0] for r in packed} == {r[0] for r in mixed}
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r["doc_id"]), r["doc_tokens"]) for r in whole if r["start"] == 0) == sorted((str(r[0]), r[4]) for r in packed if r[1] == 0)


def test_first_sequences_hold_the_target_shares(spark, tmp_path, monkeypatch):
    hot, cold, tokens = 20_480, 2_560, 400
    ids = spark.range(hot + cold).withColumnRenamed("id", "doc_id")
    docs = ids.select("doc_id", F.repeat(F.lit("the "), tokens - 1).alias("text"), F.when(F.col("doc_id") < hot, "hot").otherwise("cold").alias("source"))
    # later slots make larger files, which Spark reads first
    docs = docs.withColumn("note", F.repeat(F.sha2(F.col("doc_id").cast("string"), 512), F.when(F.xxhash64("doc_id") > 0, 40).otherwise(1)))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    sequences = defaultdict(lambda: [0, 0])
    try:
        rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for r in rows:
        sequences[r["sequence_id"]][r["doc_id"] < hot] += r["length"]
    share = cold**0.7 / (hot**0.7 + cold**0.7)
    slack = 256 * tokens + packing.WINDOW_TOKENS + 10
    n_cold = n_all = 0
    for s in sorted(sequences):
        n_cold, n_all = n_cold + sequences[s][0], n_all + sum(sequences[s])
        if n_all * share < (cold - 256) * tokens:
            assert abs(n_cold - n_all * share) <= slack + 0.001 * n_all
    assert n_cold == cold * tokens and n_all == (hot + cold) * tokens


def test_windows_follow_each_other(spark):
    docs = spark.range(3_000).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("the "), (F.col("id") * 7919 % 300).cast("int")).alias("text"))
    got = packing.pack_documents(docs, in_order=True).orderBy("sequence_id", "offset").collect()
    filled, pieces = defaultdict(int), defaultdict(list)
    for r in got:
        assert r["offset"] == filled[r["sequence_id"]]
        filled[r["sequence_id"]] += r["length"]
        pieces[r["doc_id"]].append((r["start"], r["length"], r["doc_tokens"]))
    for i, own in pieces.items():
        at = 0
        for start, length, total in sorted(own):
            assert start == at and total == i * 7919 % 300 + 1
            at += length
        assert at == total
    full = filled[max(filled)] if len(filled) == 1 else 4096
    short = [s for s, n in filled.items() if n != full]
    assert len(pieces) == 3_000 and len(short) <= 12 and min(short, default=0) > max(filled) - 13


def test_a_document_is_cut_only_if_no_sequence_has_room():
    # ten cheap sequences have 96 tokens left, the dear one 1096
    lengths = [3000] + [1000] * 40 + [100] * 10 + [96] * 11
    assert sorted(p[0] for p in packing.pack(lengths)) == list(range(len(lengths)))
