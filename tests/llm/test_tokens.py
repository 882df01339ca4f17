import base64
import hashlib
import json
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscan.llm import byte_bpe, mixing, sharding, token_files
from folioscan.llm.html_text import extract_main_text, main_text
from folioscan.llm.token_counts import TokenLedger, changes, counted

RANKS, WORDS = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json")
ODD = "abC \n\t'sdÉ日本語́̈  \x1c\x85　 12!?,.%½Ⅷ𝔸😀ΣİßǅÅ"
TEXTS = ["", None, " ", "Hello, world. It's   me\n\n<|endoftext|> again.", "x" * 30000, "ab " * 20000, "日本語の文章です。", "a", "\x00b", "Than, than. THAN."]


def odd_texts(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 16))) for _ in range(n)]


def documents(spark, texts):
    return spark.createDataFrame([(k * 3, t, k) for k, t in enumerate(texts)], "doc_id bigint, text string, id bigint")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_byte_bpe_equals_tiktoken(reference):
    coder = byte_bpe.ByteBPE(byte_bpe.read_ranks(RANKS), P.PATTERN)
    tokens = sorted(coder.ranks)
    rng = random.Random(4)
    joined = ["".join(rng.choice(tokens).decode("utf-8", "ignore") for _ in range(4)) for _ in range(3000)]
    for text in [t or "" for t in TEXTS] + odd_texts(5000) + joined:
        ids = coder.encode(text)
        assert ids == reference.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_byte_bpe_query(spark, reference):
    texts = TEXTS + odd_texts(50)
    got = {r.doc_id: r for r in byte_bpe.byte_bpe_round_trip(documents(spark, texts), RANKS, P.PATTERN, keep_ids=True).collect()}
    for k, t in enumerate(texts):
        packed = np.array(reference.encode_ordinary(t or ""), dtype="<u4").tobytes()
        r = got[k * 3]
        assert (r.n_tokens, r.ids_sha256, bytes(r.ids)) == (len(packed) // 4, hashlib.sha256(packed).hexdigest(), packed)
        assert r.decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert byte_bpe.byte_bpe_round_trip(documents(spark, texts).limit(0), RANKS, P.PATTERN).count() == 0


def test_byte_bpe_of_repeated_rows_and_ties(spark, reference):
    rows = [(1, "than it"), (1, "than it"), (1, None), (None, "than"), (None, "é" * 40_000)]
    docs = spark.createDataFrame([(*r, 3) for r in rows], "doc_id bigint, text string, n_tokens int")
    got = Counter((r.doc_id, r.n_tokens, r.decoded_sha256) for r in byte_bpe.byte_bpe_round_trip(docs, RANKS, P.PATTERN).collect())
    assert got == Counter((i, len(reference.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)


def test_memory_of_words_is_bounded():
    memo = byte_bpe.Memo(lambda x: x * 2, 10)
    assert [memo[k % 37] for k in range(1000)] == [k % 37 * 2 for k in range(1000)] and len(memo) + len(memo.old) <= 10


MARKED = ["hello <|endoftext|> world <|endoftext|>x", "<|startoftext|>", "<|ENDOFTEXT|> a", "a.<|endoftext|>,"]


def test_word_encoder_equals_library():
    tokenizer = Tokenizer.from_file(WORDS)
    encoder = token_files.WordEncoder(WORDS)
    assert encoder.by_words
    for text in [t or "" for t in TEXTS] + odd_texts(3000, 2) + MARKED:
        assert encoder.encode(text.encode()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert encoder.encode(MARKED[0].encode()).tolist() == [3306, 49407, 1002, 49407, 343]


def test_other_tokenizers_are_encoded_by_the_library():
    path = P.path("byte_bpe_50k.json")
    tokenizer, encoder = Tokenizer.from_file(path), token_files.WordEncoder(path)
    assert not encoder.by_words
    for text in [t or "" for t in TEXTS] + odd_texts(300, 3) + MARKED:
        assert encoder.encode(text.encode()).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_other_patterns_are_split_in_the_text():
    pattern = r"\p{L}+\s?|[^\p{L}]+"
    ranks = byte_bpe.read_ranks(RANKS)
    coder, theirs = byte_bpe.ByteBPE(ranks, pattern), tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    for text in [t or "" for t in TEXTS] + odd_texts(500, 5):
        assert coder.encode(text) == theirs.encode_ordinary(text)


def test_token_files(spark, tmp_path):
    texts = TEXTS + odd_texts(40) + MARKED
    docs, folder = documents(spark, texts), f"file://{tmp_path}/tokens"
    shards = token_files.write_token_files(docs, folder, WORDS, length=16, rows=4, shards=3)
    got = sorted(token_files.read_token_files(docs, folder, shards).collect(), key=lambda r: r.doc_id)
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    every = []
    for r, (k, t) in zip(got, enumerate(texts), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (k * 3, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)
        every.append(ids)
    assert sum(n for _, _, n in shards) == start
    # random access: sequences of equal length, views of the mapped file, padding masked
    file = token_files.open_sequences(folder, shards[0][0])
    flat = np.concatenate([file.ids(k)[file.mask(k)] for k in range(len(file))])
    assert flat.tolist() == [i for ids in every for i in ids][: len(flat)] and len(flat) == shards[0][2]
    assert {len(file.ids(k)) for k in range(len(file))} == {16} and not file.ids(0).flags.owndata and file.ids(0).dtype == np.uint16
    assert token_files.write_token_files(docs.limit(0), folder + "-none", WORDS) == []
    assert token_files.token_round_trip(docs.limit(0), WORDS, folder=folder + "-none").count() == 0


def test_token_files_of_equal_ids_and_rows(spark, tmp_path):
    rows = [(1, "b"), (1, "a"), (None, "x y"), (1, "b"), (None, None), (0, "q " * 50_000), (1, "c"), (1, "d")]
    docs = spark.createDataFrame([(*r, 9) for r in rows], "doc_id bigint, text string, start bigint")
    folder = f"file://{tmp_path}/t"
    shards = token_files.write_token_files(docs, folder, WORDS, shards=4)
    got = sorted(token_files.read_token_files(docs, folder, shards).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 0, 1, 1, 1, 1, 1] and got[0].start == 0
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:]))
    tokenizer = Tokenizer.from_file(WORDS)
    crc = lambda t: zlib.crc32(np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes())
    assert Counter((r.doc_id, r.ids_crc32) for r in got) == Counter((i, crc(t)) for i, t in rows)
    with pytest.raises(ValueError):  # the shards of another run are never mixed with these
        token_files.write_token_files(docs, folder, WORDS)


def test_token_files_are_the_same_again(spark, tmp_path):
    docs = documents(spark, TEXTS)
    once, again = (token_files.write_token_files(docs, f"file://{tmp_path}/{x}", WORDS, shards=2) for x in "ab")
    assert once == again and all((tmp_path / "a" / p.name).read_bytes() == p.read_bytes() for p in (tmp_path / "b").iterdir())


def brute_targets(sizes, weights, total):
    fixed = {}
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left, weight = total - sum(fixed.values()), sum(weights[i] for i in rest)
        over = [i for i in rest if left * weights[i] / weight > 2 * sizes[i]]
        if not over:
            return [fixed.get(i, left * weights[i] / weight if i in rest else 0) for i in range(len(sizes))]
        fixed |= {i: 2 * sizes[i] for i in over}


def mixable(spark, n=600):
    rng = random.Random(8)
    rows = [(k, " ".join(["w"] * rng.randint(0, 60)), rng.choice(["a", "a", "a", "B", "é", None, "c"])) for k in range(n)]
    return spark.createDataFrame([(*r, 5) for r in rows], "doc_id bigint, text string, source string, size int")


def test_mix(spark):
    docs = mixable(spark)
    got = mixing.mix_summary(docs).collect()
    assert len(got) == 600 and all(r.taken <= 2 * r.size for r in got)
    source = {r.doc_id: r.source for r in docs.collect()}
    order = sorted(set(source.values()), key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in got if source[r.doc_id] == s) for s in order]
    for s, size, target in zip(order, sizes, brute_targets(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes))):
        rows = [r for r in got if source[r.doc_id] == s]
        assert {r.source_size for r in rows} == {size} and rows[0].target == pytest.approx(target)
        assert abs(sum(r.taken for r in rows) - target) <= 60
    again = mixing.mix_summary(docs.repartition(7)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    assert mixing.mix_summary(docs.limit(0)).count() == 0


def test_mix_deals_blocks_to_shards(spark):
    docs = mixable(spark)
    rows, taken = mixing.mix_sources(docs, shards=5, block_docs=20).collect(), mixing.mix_summary(docs, block_docs=20).collect()
    assert sum(r.size for r in rows) == sum(r.taken for r in taken)
    assert len({(r.id, r.copy) for r in rows}) == len(rows) and {r.shard for r in rows} <= set(range(5))
    assert Counter(r.id for r in rows) == Counter({r.doc_id: r.taken // r.size for r in taken if r.taken})


def test_mix_summary_counts_what_the_shards_draw(spark, monkeypatch):
    docs = mixable(spark)
    docs = docs.union(docs.where("doc_id < 50"))  # rows that repeat are documents of their own
    rows, split = mixing.mix_sources(docs, shards=5, block_docs=20).collect(), mixing.split_quotas
    first = Counter()
    for r in rows:
        first[r.id] += r.size * (r.shard == 0)

    def only_first(quotas, shards, seed):
        out = split(quotas, shards, seed)
        out[1:] = 0
        return out

    monkeypatch.setattr(mixing, "split_quotas", only_first)
    taken, summary = Counter(), mixing.mix_summary(docs, shards=5, block_docs=20).collect()
    for r in summary:
        taken[r.doc_id] += r.taken
    assert len(summary) == 650 and 0 < sum(first.values()) < sum(r.size for r in rows) and taken == first


def test_mix_draws_disjoint_permuted_blocks(spark):
    """The blocks that each shard draws, by brute force from the rows of the mix."""
    docs = mixable(spark, 900)
    rows = mixing.mix_sources(docs, shards=6, block_docs=10).collect()
    size, source = {r.doc_id: len((r.text or "").split()) for r in docs.collect()}, {r.doc_id: r.source for r in docs.collect()}
    shard_of = {}
    for r in rows:
        assert shard_of.setdefault((r.id, r.copy), r.shard) == r.shard and r.size == size[r.id]
    drawn = defaultdict(int)
    for r in rows:
        drawn[r.source] += r.size
    order = sorted({*source.values()}, key=lambda s: (s is None, s or ""))
    sizes = [sum(size[i] for i, s in source.items() if s == x) for x in order]
    for x, target in zip(order, brute_targets(sizes, [3, 1, 2, 3, 1], 1.5 * sum(sizes))):
        assert abs(drawn[x] - target) <= 60
    places = [[r.id for r in sorted(rows, key=lambda r: r.place) if r.shard == s] for s in range(6)]
    assert all(p != sorted(p) for p in places if len(p) > 9)  # shuffled within a shard


def test_mix_of_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "w " * 100_000, "a"), (4, "w", None), (4, "w", None), (None, "w w", "b"), (5, None, "empty")]
    docs = spark.createDataFrame([(*r, 1.0, 7) for r in rows], "doc_id bigint, text string, source string, target double, taken int")
    got = mixing.mix_summary(docs).collect()
    assert len(got) == 7 and all(r.taken <= 2 * r.size for r in got) and {r.doc_id for r in got if not r.size} == {1, 2, 5}
    assert sorted(r.taken for r in got if r.doc_id == 4) == [2, 2] and [r.source_size for r in got if r.doc_id == 5] == [0]


def test_quotas_are_split_exactly():
    parts = mixing.split_quotas([100, 0, 7, 993], 7, 1)
    assert parts.sum(axis=0).tolist() == [100, 0, 7, 993] and parts.sum(axis=1).max() - parts.sum(axis=1).min() <= 2 and (parts >= 0).all()
    shares = np.mean([mixing.split_quotas([50, 150], 4, s)[0] for s in range(300)], axis=0)
    assert shares == pytest.approx([12.5, 37.5], abs=0.6)


def test_shards(spark):
    rng = random.Random(6)
    rows = [(k, "x" * rng.randint(0, 300), f"s{rng.randrange(3)}", "en") for k in range(1500)] + [(2000 + k, "copy " * 30, "hot", None) for k in range(1200)] + [(None, None, None, None), (7, "twice", "s", "en"), (7, "twice", "s", "en")]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id bigint, text string, source string, lang string, shard int")
    got = sharding.kd_shards(docs, 24).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    assert len(got) == len(rows) and set(sizes) == set(range(24))
    assert max(sizes.values()) - min(sizes.values()) < 0.1 * sum(sizes.values()) / 24
    for s in range(24):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == {(i, len(t or "") + 8, zlib.crc32((t or "").encode())) for i, t, *_ in rows}
    assert sharding.kd_shards(docs.limit(0)).count() == 0
    by_size = Counter()
    for r in sharding.kd_shards(docs, leaf_bytes=100_000).collect():
        by_size[r.shard] += r.size
    assert len(by_size) == -(-sum(sizes.values()) // 100_000) and max(by_size.values()) < 101_000
    with pytest.raises(ValueError):
        sharding.kd_shards(docs, leaf_bytes=1)
    few = sharding.kd_shards(docs.limit(5), 24).collect()
    assert len(few) == 5 and len({r.shard for r in few}) >= 4


def brute_shards(points, leaves):
    """Shards of (size, coordinates, tie, own) by the definition of the k-d tree."""
    spans = [max(p[1][d] for p in points) - min(p[1][d] for p in points) for d in range(4)]
    out = {}

    def split(here, first, n):
        if n == 1 or not here:
            out.update({k: first for k in here})
            return
        wide = [(max(points[k][1][d] for k in here) - min(points[k][1][d] for k in here)) / spans[d] if spans[d] else 0 for d in range(4)]
        d = wide.index(max(wide))
        here = sorted(here, key=lambda k: (points[k][1][d], points[k][2], points[k][3]))
        wanted, total, cut = sum(points[k][0] for k in here) * (n // 2) / n, 0, 0
        while cut < len(here) and 2 * (wanted - total) >= points[here[cut]][0]:
            total += points[here[cut]][0]
            cut += 1
        split(here[:cut], first, n // 2)
        split(here[cut:], first + n // 2, n - n // 2)

    split(list(range(len(points))), 0, leaves)
    return out


def test_shards_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sharding, "TOLERANCE", 0.0)
    monkeypatch.setattr(sharding, "MOST_BUCKETS", 16)  # several rounds of histograms
    rng = random.Random(12)
    rows = [(k, "x" * rng.randint(0, 90) + str(k % 170), rng.choice(["source-a", "source-b", "src9", None]), rng.choice(["en", "de", None])) for k in range(400)]
    rows += [(1000 + k, "copy " * 9, "hot", "en") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string")
    with sharding.Scratch(spark) as scratch:
        found = sorted(sharding._points(scratch, docs, "doc_id", "text").collect())
        assert len({r.d1 for r in found}) == 5  # names of one prefix are told apart
    expected = brute_shards([(r.size, (r.d0, r.d1, r.d2, r.d3), r.tie, r.own) for r in found], 24)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.kd_shards(docs, 24).collect()}
    assert {found[k].id: shard for k, shard in expected.items()} == {i: s for i, (s, _) in got.items()}
    for s in range(24):
        assert [i for i, x in sorted(got.items(), key=lambda x: x[1][1]) if x[0] == s] == sorted(i for i, x in got.items() if x[0] == s)


def test_shards_of_odd_rows(spark):
    rows = [(1, None), (1, None), (None, ""), (2, "y" * 500_000), (3, "z")]
    got = sharding.kd_shards(spark.createDataFrame([(*r, "old") for r in rows], "doc_id bigint, text string, law string"), 3).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=repr) == sorted([(1, 8), (1, 8), (None, 8), (2, 500_008), (3, 9)], key=repr)
    alone = next(r.shard for r in got if r.doc_id == 2)
    assert [r.doc_id for r in got if r.shard == alone and r.size > 9] == [2]


def test_ledger(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    assert ledger.totals().count() == 0
    docs = spark.createDataFrame([("a", "en", 3), ("a", "en", 3), (None, "fr", 5), ("a", None, None)], "source string, lang string, n int")
    assert ledger.commit("b1", changes(docs, "v1", F.col("n"))) and not ledger.commit("b1", changes(docs, "v1", F.col("n")))
    ledger.commit("b2", changes(docs.where("lang = 'fr'"), "v1", F.col("n"), -1).unionByName(changes(docs.where("lang = 'fr'"), "v2", F.col("n") + 1)))
    expected = sorted([("a", "en", "v1", 2, 6), (None, "fr", "v1", 0, 0), (None, "fr", "v2", 1, 6), ("a", None, "v1", 1, 0)], key=repr)
    assert sorted(map(tuple, ledger.totals().collect()), key=repr) == expected
    ledger.fold()
    assert sorted(map(tuple, ledger.totals().collect()), key=repr) == expected
    assert not TokenLedger(spark, f"file://{tmp_path}/ledger").commit("b2", changes(docs, "v1", F.col("n")))
    assert sorted(map(tuple, ledger.totals().collect()), key=repr) == expected
    # sums that no commit names don't count
    changes(docs, "v9", F.col("n")).write.parquet(f"file://{tmp_path}/ledger/data/b9-dead")
    assert ledger.totals().where("tokenizer = 'v9'").count() == 0
    with pytest.raises(ValueError):
        ledger.commit("../x", docs)


def test_a_fold_keeps_what_commits_meanwhile(spark, tmp_path, monkeypatch):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    docs = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n int")
    total = lambda: ledger.totals().first().tokens
    ledger.commit("b1", changes(docs, "v", F.col("n")))
    ledger.commit("b2", changes(docs, "v", F.col("n")))
    publish = TokenLedger._publish

    def late(self, name, batches, data):
        if name.startswith("~"):
            monkeypatch.setattr(TokenLedger, "_publish", publish)
            ledger.commit("b3", changes(docs, "v", F.col("n")))
        return publish(self, name, batches, data)

    monkeypatch.setattr(TokenLedger, "_publish", late)
    assert ledger.fold() and total() == 15 and set(ledger.committed()) == {"b1", "b2", "b3"}
    assert ledger.fold() and total() == 15 and not ledger.commit("b3", changes(docs, "v", F.col("n"))) and not ledger.fold()


def test_a_fold_that_dies_counts_nothing_twice(spark, tmp_path, monkeypatch):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    docs = spark.createDataFrame([("a", "en", 5)], "source string, lang string, n int")
    total = lambda: ledger.totals().first().tokens
    for k in range(6):
        ledger.commit(f"b{k}", changes(docs, "v", F.col("n")))
        if k % 2:  # published, and dead before it could delete what it read
            monkeypatch.setattr(TokenLedger, "_forget", lambda self, names: None)
            assert ledger.fold()
            monkeypatch.undo()
        assert total() == 5 * (k + 1)
    assert len(list((tmp_path / "ledger/commits").glob("~*.json"))) == 3
    # of two folds at a time one counts
    entries, ledger._entries = ledger._entries(), lambda: entries
    other = TokenLedger(spark, f"file://{tmp_path}/ledger")
    other.commit("b6", changes(docs, "v", F.col("n")))
    assert other.fold() and not ledger.fold()
    del ledger._entries
    assert total() == 35 and len(list((tmp_path / "ledger/commits").glob("*.json"))) == 1


def test_changes_of_odd_rows(spark, tmp_path):
    ledger = TokenLedger(spark, f"file://{tmp_path}/ledger")
    docs = spark.createDataFrame([(None, None, None, "x"), ("a", "en", "w " * 50_000, "x"), ("a", "en", "w " * 50_000, "x"), ("a", "en", "", "x")], "source string, lang string, text string, tokens string")
    tokens = counted(docs, {"words": WORDS, "bytes": RANKS}, P.PATTERN)
    assert ledger.commit("none", changes(tokens.limit(0), "words", F.col("words"))) and ledger.totals().count() == 0
    ledger.commit("all", changes(tokens, "words", F.col("words")).unionByName(changes(tokens, "bytes", F.col("bytes"))))
    assert sorted(map(tuple, ledger.totals().collect()), key=repr) == sorted([(None, None, "words", 1, 0), (None, None, "bytes", 1, 0), ("a", "en", "words", 3, 100_000), ("a", "en", "bytes", 3, 100_002)], key=repr)


def test_token_counts_against_the_libraries(spark, reference):
    """The query's totals, rolled up by SQL from the libraries' own counts."""
    from folioscan.llm import queries

    docs, tokenizer = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("source", "lang", "text").toPandas(), Tokenizer.from_file(WORDS)
    docs["w"] = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in docs.text]
    docs["b"] = [len(reference.encode_ordinary(t or "")) for t in docs.text]
    sql = """SELECT source, lang, 'word_bpe_49k' AS tokenizer, 0 AS documents, 0 AS tokens FROM docs GROUP BY ALL
    UNION ALL SELECT source, lang, 'byte_bpe_multi_50k', count(*) FILTER (b >= 50), coalesce(sum(b) FILTER (b >= 50), 0) FROM docs GROUP BY ALL"""
    expected = sorted(tuple(map(str, r)) for r in duckdb.sql(sql).fetchall())
    assert sorted(tuple(map(str, r)) for r in queries.op4_token_counts(spark, "/root/testdata/sf0.001").collect()) == expected


PAGE = """<html><head><title>x</title><script>var a="<p>no</p>";</script></head><body class="has-sidebar"><div id="cookie-banner">We use cookies and you will have to like it, whatever you do.</div>
<header><p>Site</p></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>{open}<h1>The  title &eacute;</h1><p>First with <a href=x>a link</a> and<br>break &amp; more words that make it long.
<p>Second is a bit longer than the first one, so that the sums of the windows rise.</p><ul><li>item</li></ul><div class="ad">Buy</div><p>End.</p>{close}
<aside><p>Related things that are long enough to be taken for text by their length alone.</p></aside><div id="comments"><p>I think that this is a great article, and I say so at length.</p></div><form><p>Mail</p></form><footer>(c)</footer>"""
ARTICLE = "The title é\nFirst with a link and break & more words that make it long.\nSecond is a bit longer than the first one, so that the sums of the windows rise.\nitem\nEnd."


@pytest.mark.parametrize("tags", [("<article>", "</article>"), ("<div class='content with-sidebar'>", "</div>"), ("<main>", "</main>"), ("", "")])
def test_main_text(tags):
    assert main_text(PAGE.replace("{open}", tags[0]).replace("{close}", tags[1])) == ARTICLE


LINE = "A paragraph of the article with so many words that the sums of the windows rise, number {}."


def test_main_text_goes_on_after_gaps_and_links():
    one, two, three = (LINE.format(k) for k in "123")
    boxes = "<div class=ad>Buy</div><form><p>Mail</p></form><aside><p>Related</p></aside>"
    links = "<p><a href=x>More</a></p>" * 3
    menu = "<ul><li><a href=1>One</a><li><a href=2>Two</a></ul>"
    for gap in (boxes, links):
        assert main_text(f"{menu}<div><p>{one}</p><p>{two}</p>{gap}<p>Short.</p>{gap}<p>{three}</p></div>{menu}") == f"{one}\n{two}\nShort.\n{three}"
    sources = "<p><a href=x>Source</a></p>"
    assert main_text(f"{menu}<article>{sources}<p>{one}</p>{boxes}{sources}</article>{menu}") == f"Source\n{one}\nSource"
    assert main_text(f"{menu}<article><p>{one}</p></article>{boxes}<article><p>{two}</p><p>{three}</p></article><p>{LINE}</p>") == f"{one}\n{two}\n{three}"


@pytest.mark.parametrize("name, kept", [("share-price-table", True), ("search-for-truth", True), ("notice-of-intent", True), ("catalog", True), ("has-sidebar", True), ("comment-list", False), ("site_footer top", False), ("cookie-banner", False), ("story ad", False)])
def test_names_are_hints_as_a_whole(name, kept):
    one, two = LINE.format(1), LINE.format(2)
    for page in (f"<article><p>{one}</p><div class='{name}'>{two}</div><p>End.</p></article>", f"<p>{one}</p><section id='{name}'>{two}</section><p>End.</p>"):
        assert main_text(page) == (f"{one}\n{two}\nEnd." if kept else f"{one}\nEnd.")


def brute_main_text(blocks, lengths, surge):
    """The method by its definition: ``blocks`` are texts, or None where nothing may be
    kept, and ``lengths`` what each adds to the windows of three."""
    total = lambda i: sum(lengths[i : i + 3])

    def spans(surge):
        out, i = [], 0
        while i < len(blocks):
            if lengths[i] and total(i) > surge:
                start = i
                while i < len(blocks) and total(i):
                    i += 1
                out.append(range(start, max(k for k in range(start, i) if lengths[k]) + 1))
            i += 1
        return out

    found = spans(surge) or spans(0)
    inside = {i for span in found for i in span}
    return "\n".join(x for i, x in enumerate(blocks) if x and inside and min(inside) <= i <= max(inside) and (lengths[i] or i in inside))


@pytest.mark.parametrize("mark", ["", "article", "main"])
def test_windows_against_brute_force(mark):
    rng = random.Random(mark)
    for _ in range(500):
        page, items, inside = "", [], False  # (text, is a link, is marked)
        for _ in range(rng.randint(1, 25)):
            if mark and rng.random() < 0.25:
                page += f"</{mark}>" if inside else f"<{mark}>"
                inside = not inside
            kind, text = rng.choice("tttlb"), " ".join(rng.choice(["a", "word", "longer-word"]) for _ in range(rng.choice([1, 4, 12])))
            page += {"t": f"<p>{text}</p>", "l": f"<div><a href='x'>{text}</a></div>", "b": f"<aside>{text}</aside>"}[kind]
            items.append((None if kind == "b" else text, kind == "l", inside))
        page += f"</{mark}>" if inside else ""
        marked = [len(t) if t and m and (mark == "article" or not link) else 0 for t, link, m in items]
        plain = [len(t) if t and not link else 0 for t, link, _ in items]
        if any(marked):
            assert main_text(page) == brute_main_text([t if m else None for t, _, m in items], marked, 0)
        else:
            assert main_text(page) == brute_main_text([t for t, _, _ in items], plain, 80)


def test_odd_pages(spark):
    pages = {"": "", "plain": "plain", "<p>a<p>b": "a\nb", "<nav>menu</nav>": "", "<div title='a hidden nav' data-class=ad>seen</div>": "seen", "<p>a</p><div hidden>no</div><p class=ad>no</p>": "a", "<p>x <b": "x", '<p title="a>b">q</p>': "q", "<div class='ad'><p>lost div": "lost div", "<p>" + "w " * 50000: ("w " * 50000).strip(), "<p>&lt;b&gt;&nbsp;c</p>": "<b> c"}
    docs = spark.createDataFrame([(k, None, h, "t") for k, h in enumerate([*pages, None])], "page_id bigint, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in extract_main_text(docs).collect()}
    assert got == {k: (t, len(t)) for k, t in enumerate([*pages.values(), ""])}
    assert extract_main_text(docs.limit(0)).count() == 0


def test_repeated_pages_and_ties(spark):
    rows = [(1, "u", "<p>a</p>"), (1, "u", "<p>a</p>"), (1, None, "<p>b</p>"), (None, "u", None)]
    got = extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string")).collect()
    assert Counter(map(tuple, got)) == Counter([(1, "u", "a", 1), (1, "u", "a", 1), (1, None, "b", 1), (None, "u", "", 0)])


def test_articles_of_the_test_pages(spark):
    """The generator's pages mark their article; its blocks are what must come out."""
    import html
    import re

    pages, blind = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect(), 0
    for r in pages:
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article))
        expected = "\n".join(b for b in blocks if b)
        assert main_text(r.html) == expected
        blind += main_text(re.sub("</?article>", "", r.html)) == expected  # by the windows alone
    assert blind > 0.98 * len(pages)


def test_queries_equal_sql(spark):
    from folioscan.llm import oracles, queries

    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    for name, sql in oracles.ORACLE_SQL.items():
        ours, theirs = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.execute(sql).df()
        columns = sorted(theirs.columns)
        key = lambda f: sorted(f[columns].astype(str).itertuples(index=False, name=None))
        assert sorted(ours.columns) == columns and key(ours) == key(theirs), name
    assert json.dumps(sorted(queries.QUERIES))
