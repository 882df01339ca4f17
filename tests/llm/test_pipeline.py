"""The pipeline's stages against brute force on the smallest test data."""

from collections import Counter, defaultdict

import public_tokenizers as P
from test_dedup_and_quality import brute_components

import corpus_pipeline
from folioscan.llm.byte_bpe import ByteBPE, read_ranks

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id: r.text for r in docs.collect()}
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, SF), "t")
        assert docs.columns == columns, name
        seen.append({(r.doc_id): r.text for r in docs.collect()})
        if name != "mix sources":
            assert docs.count() == len(seen[-1])
    clean, unique, far, mixed = seen
    assert 0 < len(clean) < len(before) and all(set(t.split("\n")) <= set(before[i].split("\n")) for i, t in clean.items())
    newest = {}
    for i, t in clean.items():
        newest[t] = max(i, newest.get(t, i))
    assert set(unique) == set(newest.values())
    roots = brute_components(sorted(unique.items()), 5, 80)
    assert set(far) == {r for _, r in roots.values()}
    passes, source = Counter(r.doc_id for r in docs.collect()), {r.doc_id: r.source for r in docs.collect()}
    assert set(mixed) <= set(far) and max(passes.values()) <= 2
    words = {i: len(t.split()) for i, t in far.items()}
    per_source = defaultdict(int)
    for i, n in passes.items():
        per_source[source[i]] += n * words[i]
    assert sum(per_source.values()) == __import__("pytest").approx(1.5 * sum(words.values()), rel=0.15)
    coder = ByteBPE(read_ranks(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in last) == Counter((i, len(coder.encode(mixed[i]))) for i in passes.elements())


def test_stages_on_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "x " * 60, "en", "a", 1), (3, "Word %d. " * 5, "en", None, 1)]
    docs = spark.createDataFrame(rows, schema)
    got = {name: Counter(tuple(r)[0] for r in stage(spark, docs, SF).collect()) for name, stage in corpus_pipeline.STAGES}
    assert got == {
        "quality rules": Counter(),  # too short, or all words repeat
        "exact dedup": Counter([2, None, 3]),  # null counts as empty
        "near dedup": Counter([1, 2, None, 3]),
        "mix sources": Counter([None, 3, 3]),  # targets 85 of 60 words and 20 of 10
        "byte BPE": Counter([1, 2, None, 3]),
    }
    counts = {r.doc_id: r.n_tokens for r in corpus_pipeline.encode(spark, docs, SF).collect()}
    assert counts[1] == counts[2] == 0 and counts[3] > 10
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
    long = spark.createDataFrame([(k, " ".join(f"w{i}{'.' * (i % 12 == 11)}" for i in range(k, 60_000)) + ".", "en", "a", 1) for k in (5, 5, 6)], schema)
    left = [stage(spark, long, SF).count() for _, stage in corpus_pipeline.STAGES]
    # two equal rows, and one nearly so; the mix takes 150 % of the words, 4.5 documents of them
    assert left[:3] == [3, 2, 1] and left[3] in (4, 5) and left[4] == 3


def test_stages_tell_rows_apart(spark):
    def run(stage, rows):
        docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        return Counter((r.doc_id, r.text) for r in stage(spark, docs, SF).collect())

    one, two = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    near = two.replace("b59", "c")
    # repeated rows are copies, and rows without an id may stay
    assert run(corpus_pipeline.drop_copies, [(1, one), (1, one), (None, two), (None, one), (1, near)]) == Counter([(1, one), (None, two), (1, near)])
    assert run(corpus_pipeline.drop_near_copies, [(1, two), (7, near), (7, one), (None, "x y z")]) == Counter([(1, two), (7, one), (None, "x y z")])
    # the mix takes each of two equal rows at most twice
    assert sum(run(corpus_pipeline.mix, [(1, one), (1, one)]).values()) == 3
