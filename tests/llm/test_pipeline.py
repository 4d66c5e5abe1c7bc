import hashlib

import corpus_pipeline
import regex

from rotorlake.llm import quality_gam

from .test_documents import naive_groups, naive_leaks
from .test_models import naive_features
from .test_tokens import by_tiktoken


def naive_margin(model, x):
    """A score's logit by looking up every bin."""
    bins = lambda edges, v: sum(e <= v for e in edges)
    out = model.base + sum(float(t[bins(e, v)]) for e, t, v in zip(model.edges, model.tables, x, strict=True))
    return out + sum(float(t[bins(model.pair_edges[i], x[i]), bins(model.pair_edges[j], x[j])]) for (i, j), t in model.pairs.items())


def test_each_stage_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality_gam.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    wanted = [
        lambda rows: {k for k, t in rows if naive_margin(model, naive_features(t)) >= 0},
        lambda rows: {k for k, t in rows if regex.search(r"\p{L}", t or "")},
        lambda rows: {low for _, _, low in naive_groups(rows)},
        lambda rows: {k for k, _, hit, _, _ in naive_leaks(rows, items, 10) if not hit},
    ]
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted, strict=False):
        docs = stage(spark, docs, sf_dir).persist()
        stay = want(sorted(kept.items()))
        assert docs.columns == columns and sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(stay), name
        kept = {k: kept[k] for k in stay}
    out = corpus_pipeline.STAGES[4][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"]: r["token_ids"] for r in out} == {k: by_tiktoken(t) for k, t in kept.items()}
    assert all(r["decoded_sha256"] == hashlib.sha256(kept[r["doc_id"]].encode()).hexdigest() and r["n_tokens"] == len(r["token_ids"]) for r in out)


def test_empty_and_odd_tables(spark, sf_dir, odd, none):
    for docs in (none.select("doc_id", "text", "lang", "source", "n_chars", "score"), odd):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf_dir).persist()
            docs.count()
