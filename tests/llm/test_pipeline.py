"""The pipeline stage by stage: each stage's rows follow from its own input, by brute force where that can be had."""

from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_corpus import brute_components, brute_fingerprint, brute_hits, lower, words_of

import corpus_pipeline
from keystrata.llm import decontaminate, mixing, passages, quality
from keystrata.llm.registry import DOMAIN_WEIGHTS, source_domain

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="driver tables are not here")


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    bench = [tuple(r) for r in spark.read.parquet(str(SF / "benchmark.parquet")).select("item_id", "text").collect()]
    cols = docs.columns
    ins, outs = {}, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        ins[name] = docs
        stage(spark, docs, str(SF)).write.parquet(str(tmp_path / str(n)))
        docs = outs[name] = spark.read.parquet(str(tmp_path / str(n)))
        assert n == 4 or docs.columns == cols
    text = lambda df: {r.doc_id: r.text for r in df.collect()}

    kept = {r.doc_id for r in quality.quality_rules(ins["quality_rules"], spark.read.parquet(str(SF / "labels.parquet"))).where("kept").collect()}
    raw = text(ins["quality_rules"])
    assert text(outs["quality_rules"]) == {i: raw[i] for i in kept} and 0 < len(kept) < len(raw)

    before = text(ins["simhash_near_dedup"])
    roots = set(brute_components({i: brute_fingerprint(t) for i, t in before.items()}).values())
    assert text(outs["simhash_near_dedup"]) == {i: before[i] for i in roots}

    before, after = text(ins["substring_dedup"]), text(outs["substring_dedup"])
    cut = {}
    for r in passages.shared_passages(ins["substring_dedup"]).collect():
        cut.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        a, b = (list(map(lower, words_of(before[i])))[x:y] for i, x, y in ((r.doc_id, r.start, r.end), (r.source_id, r.source_start, r.source_end)))
        common = sum((Counter(a) & Counter(b)).values())
        assert r.source_id < r.doc_id and 2 * common >= 0.8 * (len(a) + len(b))
    for i, t in before.items():
        left = [w for k, w in enumerate(words_of(t)) if k not in cut.get(i, ())]
        assert words_of(after[i]) == left if left else i not in after
        assert i in cut or after[i] == t

    before, after = text(ins["benchmark_decontamination"]), text(outs["benchmark_decontamination"])
    hits = {i: brute_hits(t, bench, 10) for i, t in before.items()}
    assert set(after) == {i for i, h in hits.items() if 2 * h[1] <= h[0]} and any(h[4] for h in hits.values())
    for i, t in after.items():
        assert t == before[i] if not hits[i][4] else len(decontaminate.normal_words(t.encode())) == hits[i][0] - hits[i][1]
    for r in outs["benchmark_decontamination"].where("text is not null").collect():
        assert r.n_chars == len(r.text) or r.text == raw[r.doc_id]

    rows = ins["source_mixing"].select("text", "lang", "source", source_domain().alias("d")).collect()
    tokens = Counter()
    for r in rows:
        tokens[r.d, r.lang or "", r.source or ""] += len(words_of(r.text))
    budgets = mixing.leaf_budgets(sum(tokens.values()), tokens, DOMAIN_WEIGHTS, 2)
    taken = Counter()
    for r in outs["source_mixing"].collect():
        taken[r.domain, r.lang or "", r.source or ""] += r.take_tokens
    assert taken == Counter({k: n for k, n in budgets.items() if n})


def test_run(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "source_mixing"]
    out = corpus_pipeline.run(spark, str(SF))
    assert out.where(F.col("take_tokens") > F.col("n_tokens")).count() == 0 and out.count() > 0
