import corpus_pipeline
from concord.llm import toxicity_gru
from concord.llm.toxicity_gru import fitted, score_texts
from tests.llm.test_bin_slack import holds
from tests.llm.test_randomness_tests import brute as secret_spans
from tests.llm.test_simhash_similar import kept as near
from tests.llm.test_suffix_match import brute as hits


def masked(text, spans):
    out, at = [], 0
    for s, e in sorted(spans):
        if s > at or not out:
            out += [text[at:s], "[secret]"]
        at = max(at, e)
    return "".join(out) + text[at:] if out else text


def test_run_against_brute_force(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    net = fitted(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    monkeypatch.setattr(toxicity_gru, "fitted", lambda *a, **b: net)
    monkeypatch.setattr(corpus_pipeline, "without_toxic", toxicity_gru.without_toxic)
    pairs = sorted((r["doc_id"], r["text"]) for r in docs.collect())
    scores = score_texts(net, [t.encode() for _, t in pairs])
    pairs = [p for p, s in zip(pairs, scores) if s < 0.3]
    text = dict(pairs)
    stay = near(pairs)
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in hits([(i, text[i]) for i in stay], bench) if r[5]}
    assert bad
    clean = [(i, text[i]) for i in stay if i not in bad]
    spans = {r[0]: [tuple(map(int, x.split(":")[1:])) for x in r[5].split(",") if x] for r in secret_spans(clean)}
    final = [(i, masked(t, spans[i])) for i, t in clean]
    assert any("[secret]" in t for _, t in final)
    holds(final, corpus_pipeline.run(spark, sf).collect())


def test_stages_keep_the_columns_of_documents(spark, sf, docs_of):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for df in (docs, docs_of([]), docs_of([(1, None), (1, None), (None, "x")])):
        for name, stage in corpus_pipeline.STAGES[1:4]:
            assert stage(spark, df, sf).dtypes == df.dtypes, name
