"""The suffix tree against its definitions by brute force, and on held-out texts."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscan.llm import suffix_tree

END = "\n"


class Brute:
    """Contexts and distributions by their definitions, for small corpora."""

    def __init__(self, texts, depth, prior, least):
        self.depth, self.prior = depth, prior
        streams = [[*t.split(), END] for t in texts]
        self.root = Counter(w for s in streams for w in s)
        self.total, self.after, self.kept = sum(self.root.values()), {}, {}
        for s in streams:
            for i in range(len(s)):
                for d in range(1, min(depth, i) + 1):
                    self.after.setdefault(tuple(s[i - d : i]), Counter())[s[i]] += 1
        for context in sorted(self.after, key=len):
            n = sum(self.after[context].values())
            self.kept[context] = n >= least and self.gain(context, n) > 0

    def gain(self, context, n):
        smooth, out = self.prior * len(self.after[context]), 0.0
        for w, c in self.after[context].items():
            parent = math.exp(-round(-math.log(self.chance(context[1:], w)) * 8) / 8)
            own = c - 1 + smooth * parent
            out += c * math.log(own / (n - 1 + smooth) / parent)
        return out

    def chance(self, context, w):
        if not context:
            return (self.root[w] + 1) / (self.total + len(self.root) + 1)
        below = self.chance(context[1:], w)
        if not self.kept.get(context):
            return below
        n, smooth = sum(self.after[context].values()), self.prior * len(self.after[context])
        return (self.after[context][w] + smooth * below) / (n + smooth)

    def score(self, text):
        s = [*text.split(), END]
        return sum(math.log10(self.chance(tuple(s[max(0, i - self.depth) : i]), w)) for i, w in enumerate(s))


@pytest.mark.parametrize("depth, prior, least", [(3, 4.0, 2), (2, 1.0, 3), (1, 2.0, 1)])
def test_scores_against_brute_force(spark, depth, prior, least, monkeypatch):
    monkeypatch.setattr(suffix_tree, "BLOCK", 300)  # many blocks
    rng = random.Random(depth)
    words = ["the", "then", "a", "ab", "éa", "b", "c", "d"]
    texts = []
    for _ in range(150):
        w = [rng.choice(words)]
        while len(w) < rng.randint(0, 40):  # what comes next depends on what stands before
            w.append(words[(words.index(w[-1]) * 3 + len(w) // 9) % 8] if rng.random() < 0.6 else rng.choice(words))
        texts.append(" ".join(w))
    held = texts[:20] + ["zz the", "", "a\nab", "the the then", "a zz a"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts + held)], "doc_id bigint, text string")
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(docs, F.col("doc_id") < len(texts), depth=depth, prior=prior, least=least).collect()}
    brute = Brute(texts, depth, prior, least)
    assert [got[k] for k in range(len(got))] == pytest.approx([brute.score(t) for t in texts + held], rel=1e-9)
    assert 0 < sum(brute.kept.values()) < len(brute.kept) or depth == 1
    # chances over all words and one unseen word make 1, whatever the context
    for context in [(), *rng.sample(sorted(brute.after), min(30, len(brute.after))), ("zz", "a")]:
        assert sum(brute.chance(context, w) for w in [*brute.root, "unseen"]) == pytest.approx(1)


def test_contexts_that_tell_nothing_are_left_out():
    # two contexts with one parent distribution: one follows it, one always has the same symbol
    parent, prior = np.array([0.5, 0.5, 0.5, 0.5]), 1.0
    n, context = np.array([50, 50, 100, 0]), np.array([0, 0, 1, 1])
    assert suffix_tree.diverges(n, context, np.array([100, 100]), np.array([2, 1]), parent, prior).tolist() == [False, True]


def test_rare_contexts_stay_in_the_tree_of_a_large_corpus(spark):
    rare = "žluťoučký kůň"  # 40 of 400,000 words
    rows = [(0, "lorem ipsum " * 100_000), (1, "lorem ipsum " * 100_000 + f"{rare} " * 20), (2, f"lorem ipsum {rare} {rare}")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r for r in suffix_tree.score_documents(docs, F.col("doc_id") != 2).collect()}
    assert got[2].score > got[2].base_score + 5


def test_scores(spark):
    docs = spark.createDataFrame([(0, "the cat", 1), (1, None, 1), (2, "The dog  the", 2), (3, "", 2), (None, "cat " * 30000, 3), (2, "new", 4), (0, "the cat", 1)], "doc_id bigint, text string, score int")
    got = suffix_tree.score_documents(docs, F.col("doc_id") != 2).collect()
    trained = Counter(w for t in ("the cat", "the cat", "", "", "cat " * 30000) for w in [*t.split(), None])
    n, v = sum(trained.values()), len(trained)
    assert len(got) == 7
    for r in got:
        text = {0: "the cat", 1: "", 3: "", None: "cat " * 30000}.get(r.doc_id, "the dog the" if r.n_tokens == 4 else "new")
        words = [*text.split(), None]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (r.doc_id == 2, len(words), sum(trained[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((trained[w] + 1) / (n + v + 1)) for w in words))
        assert r.score < 0
    assert suffix_tree.score_documents(docs.limit(0), F.lit(True)).count() == 0
    alone = suffix_tree.score_documents(docs, F.lit(False)).where("doc_id = 1").first()
    assert alone.n_known == 0 and alone.base_score == alone.score == 0


@pytest.mark.parametrize("documents", [200, 1000, 10000])
def test_held_out_texts_score_above_unigrams(spark, documents):
    folder = {200: "sf0.001", 1000: "sf0.01", 10000: "sf0.1"}[documents]
    docs = spark.read.parquet(f"/root/testdata/{folder}/documents.parquet").select("doc_id", "text")
    assert docs.count() == documents
    got = suffix_tree.score_documents(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert got[0] > got[1] + 0.08 * got[2]  # the tree alone, by so much for each token


def test_places_are_ordered_by_one_sort_of_numbers(monkeypatch):
    rng = np.random.default_rng(8)
    for codes in (rng.integers(0, 50, 1000), rng.integers(0, 9, 1000) << 58, np.zeros(0, np.int64), np.array([3])):
        with monkeypatch.context() as m:
            if codes.max(initial=0) < 1 << 50:  # sorting places by codes takes several times as long
                m.setattr(np, "argsort", None)
            order, counts = suffix_tree._order(codes)
        assert order.tolist() == sorted(range(len(codes)), key=lambda i: (codes[i], i))
        assert counts.tolist() == [n for _, n in sorted(Counter(codes.tolist()).items())]


def test_words_are_lower_cased_in_a_to_z_only(spark):
    from folioscan.llm.shared import word_hashes

    docs = spark.createDataFrame([("The ÉA\tİZ ıI Straße \x7fZ K 税A",), ("the Éa İz ıi straße \x7fz K 税a",)], "text string")
    plan = docs.select(word_hashes(F.col("text")).alias("w"))
    first, second = (r.w for r in plan.collect())
    assert first == second and len(set(first)) == 8
    # texts are not translated a character at a time as a whole
    assert "translate(coalesce" not in plan._jdf.queryExecution().analyzed().toString().lower()
