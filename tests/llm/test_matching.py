"""Decontamination, spelling variants and the prefix trie against brute force."""

import hashlib
import math
import random
import re
import zlib

import pytest

from pyspark.sql import functions as F

from folioscan.llm import spelling
from folioscan.llm.decontaminate import decontaminate
from folioscan.llm.prefix_trie import marked_turns, prefix_trie, spliced
from folioscan.llm.shared import written
from folioscan.llm.spelling import neighbours, spelling_variants, word_counts


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_decontaminate(docs, items, window):
    wins = {}
    for item, text in items:
        w = plain_words(text)
        m = min(len(w), window)
        for i in range(len(w) - m + 1) if m else ():
            wins.setdefault(tuple(w[i : i + m]), set()).add(None if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, places, listed = plain_words(text), set(), set()
        for m in {len(x) for x in wins}:
            for i in range(len(w) - m + 1):
                if tuple(w[i : i + m]) in wins:
                    places.add((i, m))
                    listed |= wins[tuple(w[i : i + m])] - {None}
        covered = {p for i, m in places for p in range(i, i + m)}
        out.append((doc_id, len(w), tuple(sorted(places)), len(covered), tuple(sorted(listed))))
    return sorted(out, key=repr)


def answers(found):
    return sorted(((r[0], r["n_words"], tuple(map(tuple, r["windows"])), r["n_hit"], tuple(r["items"])) for r in found.collect()), key=repr)


def contaminated_rows(seed):
    rng = random.Random(seed)
    letters = ["a", "b", "É", "ñ", "Z9", "x"]
    items = [(i, " ".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 3, 5, 9, 10, 12, 30])))) for i in range(25)]
    items += [(None, "null item speaks of ten words at least as one two three"), (7, None), (8, ""), (9, "the same item twice"), (9, "the same item twice"), (10, "THE same, item-twice!")]
    docs = []
    for i in range(60):
        words = [rng.choice(letters) for _ in range(rng.choice([0, 2, 9, 10, 11, 60]))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = (rng.choice(items)[1] or "").split()
            at = rng.randrange(len(words) + 1)
            words[at:at] = own[rng.randrange(3) :]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    docs += [(1, "a a"), (1, "a a"), (None, items[3][1]), (None, None), (61, None), (62, ""), (63, "a " * 500), (64, "x " * 3000 + "null item speaks of ten words at least as one two three")]
    return docs, items


@pytest.mark.parametrize("broadcast", [32 << 20, 0])
def test_decontaminate_against_brute_force(spark, broadcast):
    docs, items = contaminated_rows(3)
    found = decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), broadcast_bytes=broadcast)
    assert answers(found) == brute_decontaminate(docs, items, 10)


def test_every_shared_span_is_found(spark):
    rng = random.Random(5)
    item = [f"w{rng.randrange(50)}" for _ in range(40)]
    docs = [(n * 100 + i, " ".join(["other"] * rng.randrange(20) + item[i : i + n] + ["words"] * rng.randrange(20))) for n in (9, 10, 11, 17) for i in range(40 - n)]
    found = decontaminate(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([("i", " ".join(item))], "item_id string, text string"))
    assert all(r["n_hit"] == (0 if r["doc_id"] // 100 == 9 else r["doc_id"] // 100) for r in found.collect())


def test_decontaminate_of_odd_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b", "x")], "doc_id bigint, text string, items string"), spark.createDataFrame([(1, "a b", "x")], "item_id bigint, text string, win string")
    assert answers(decontaminate(docs, items)) == [(1, 2, ((0, 2),), 2, ("1",))]
    assert answers(decontaminate(docs, items.limit(0))) == [(1, 2, (), 0, ())]
    assert decontaminate(docs.limit(0), items).count() == 0


def brute_near(words):
    def edits(w):
        letters = set("".join(words))
        out = {w[:i] + w[i + 1 :] for i in range(len(w))} | {w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters} | {w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters}
        return out - {w}

    return {w: edits(w) for w in words}


def brute_variants(counts):
    out, form = {}, {}
    for w, edits in brute_near(set(counts)).items():
        near = sorted((x for x in edits if x in counts), key=lambda x: (-counts[x], x))
        form[w] = near[0] if near and counts[near[0]] >= 2 * counts[w] else None
        out[w] = len(near)
    root = {}
    for w in counts:
        root[w] = w
        while form[root[w]]:
            root[w] = form[root[w]]
    return sorted((w, form[w], root[w], counts[w], out[w], counts.get(form[w])) for w in counts)


def test_neighbours_are_all_edits_once():
    for words in (["abba", "bab", "c", ""], ["äöü", "aaaa"], ["é" * 7]):
        letters, made = "".join(sorted(set("".join(words)))), list(neighbours(words, "".join(sorted(set("".join(words))))))
        assert len(made) == len(set(made)) and letters
        assert {(words[i], s) for i, s in made} == {(w, s) for w, edits in brute_near(words).items() if w for s in edits}


def test_neighbours_of_a_long_word_in_tiles(monkeypatch):
    monkeypatch.setattr(spelling, "TILE", 64)
    words = ["".join(random.Random(4).choices("abcdefgh", k=40)), "abcdefgh", "aabb"]
    made = list(neighbours(words, "abcdefgh"))
    assert len(made) == len(set(made)) and {(words[i], s) for i, s in made} == {(w, s) for w, edits in brute_near(words).items() for s in edits}


def test_variants_against_brute_force(spark):
    rng = random.Random(8)
    counts = {"".join(rng.choices("abé", k=rng.randint(3, 7))): rng.choice([3, 3, 4, 6, 8, 16, 40]) for _ in range(500)}
    counts |= {"chain" + "x" * i: 3 * 2**i for i in range(12)}  # forms lead from each to the next
    found = spelling_variants(spark.createDataFrame([(w, n, "extra") for w, n in counts.items()], "word string, n bigint, root string"))
    assert sorted(map(tuple, found.collect())) == brute_variants(counts)
    assert found.where("word = 'chain'").first()["root"] == "chain" + "x" * 11


def test_variants_of_odd_tables(spark):
    empty = spark.createDataFrame([], "word string, n bigint")
    assert spelling_variants(empty).count() == 0
    assert [tuple(r) for r in spelling_variants(spark.createDataFrame([("word", 3), (None, 4)], "word string, n bigint")).collect()] == [("word", None, "word", 3, 0, None)]
    docs = spark.createDataFrame([(["aaaaa", "bbb", None], 1), (["aaaaa"], 1), (["aaaaa"], 2), (None, 3), ([], 4)], "xs array<string>, n int")
    assert [tuple(r) for r in word_counts(docs, F.col("xs")).collect()] == [("aaaaa", 3)]


def brute_trie(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    convs = {c: [x[2:] for x in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(convs.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(built[c][:d], []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[:-1] == p] for p in members}

    def below(p):
        leaves, saved = (0, 0) if children[p] else (1, 0)
        saved += (len(members[p]) - 1) * (len(p[-1][1]) if p else 0)
        for q in children[p]:
            more = below(q)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    ends = lambda p: hashlib.sha256(",".join(str(c) for c in members[p] if built[c] == p).encode()).hexdigest()
    return sorted(((m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), *below(p), ends(p)) for p, m in members.items()), key=repr)


def conversation_rows():
    rng = random.Random(6)
    rows = []
    for c in [*range(140), 200, 205, 310]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "é" * 3, "", "more"])))
    rows += [(c, t, "user", "same") for c in range(500, 560) for t in range(7)]  # copies
    rows += [(1000 + i, t, "user", f"step {t}" if t <= i else f"own {i}") for i in range(14) for t in range(16)]  # chains on chains
    rows += [(1, None, None, None), (1, 0, "user", "tie"), (1, 0, "user", "a tie"), (3, 2, None, "x"), (3, 2, None, "x"), (None, 1, "user", "lost"), (-5, 1, "user", "y"), (900, 0, "u", "t")]
    rows += [(901, 0, "u", "t"), (902, 5, "u", "z" * 5000)]
    return rows


@pytest.mark.parametrize("block", [1 << 20, 3])
def test_trie_against_brute_force(spark, block):
    rows = conversation_rows()
    turns = written(marked_turns(spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth string"), group_rows=block), "turns")
    conv = F.col("conv_id")
    convs, rebuilt = spliced(turns, conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, most=5)
    found = prefix_trie(convs, rebuilt, block=block)
    assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute_trie(rows)


def test_trie_without_conversations(spark):
    turns = marked_turns(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    convs, rebuilt = spliced(turns, F.col("conv_id"), F.lit(1), most=5)
    assert prefix_trie(convs, rebuilt).count() == 0
    alone = spark.createDataFrame([(7, 0)], "conv_id bigint, size bigint")
    assert [tuple(r)[:7] for r in prefix_trie(alone, rebuilt).collect()] == [(7, 0, None, 1, 0, 1, 0)]
