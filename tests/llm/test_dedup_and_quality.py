import hashlib
import random

import numpy as np
import pytest

from folioscan.llm import exact_dedup, near_dedup
from folioscan.llm.components import connected_components
from folioscan.llm.quality import quality_rules

DOCS = "doc_id bigint, text string, source string"
LONG = "lorem ipsum dolor sit amet " * 20000


def messy(spark):
    """Nulls, empties, ties, repeated rows, very long texts and a clashing column name."""
    rows = [(1, "a b", "x"), (2, "a b", None), (3, None, "x"), (4, "", "y"), (5, LONG, "x"), (6, LONG, "x"), (7, LONG + "!", "x"), (8, "\n \t", "x"), (9, "a b", "x"), (9, "a b", "x"), (None, "lost", "x")]
    return spark.createDataFrame([(*r, r[0], True) for r in rows], DOCS + ", keep_id bigint, kept boolean")


def test_exact_dedup_on_messy_rows(spark):
    got = sorted(map(tuple, exact_dedup.exact_dedup(messy(spark)).collect()), key=repr)
    rows = [(r.doc_id, r.text or "") for r in messy(spark).collect()]
    groups = {}
    for i, t in rows:
        groups.setdefault(t, []).append(i)
    keep = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expected = [(i, keep[t], len(groups[t]), i is not None and i == keep[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows]
    assert got == sorted(expected, key=repr)
    assert exact_dedup.exact_dedup(messy(spark).limit(0)).count() == 0


def test_chunks_are_cut_by_content():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    ends = exact_dedup.cut_points(data)
    assert ends[-1] == len(data) and ends == sorted(set(ends)) and all(b - a <= 16384 for a, b in zip([0, *ends], ends))
    moved = exact_dedup.cut_points(b"some new words" + data)
    assert len({e - 14 for e in moved} & set(ends)) > 0.8 * len(ends)  # an insert leaves most cuts
    assert exact_dedup.cut_points(b"") == [] and exact_dedup.cut_points(b"x") == [1]


def test_clashing_fingerprints_are_told_apart(spark, monkeypatch):
    docs = spark.createDataFrame([(k, c * 700) for k, c in enumerate("aabbc")], "doc_id bigint, text string")

    monkeypatch.setattr(exact_dedup, "chunk_recipes", _with_one_fingerprint(exact_dedup.chunk_recipes))
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_dedup(docs).collect()}
    assert got == {0: (1, 2), 1: (1, 2), 2: (3, 2), 3: (3, 2), 4: (4, 1)}


def _with_one_fingerprint(original):
    def clash(batches):
        import pyarrow as pa

        for b in original(batches):
            i = b.schema.get_field_index("marks")
            yield b.set_column(i, "marks", pa.array([[7] * len(x) for x in b.column(i).to_pylist()], pa.list_(pa.int64())))

    return clash


def brute_components(rows, k, percent):
    def shingles(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())

    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                lo, hi = sorted((find(i), find(j)))
                root[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_components_against_brute_force(spark, k, percent):
    rng = random.Random(k)
    words = [f"w{n}" for n in range(400)]
    rows = []
    for g in range(12):  # stars: copies of a base with few edits, so copies of copies drift apart
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 40)):
            copy = list(base)
            for _ in range(rng.randint(0, 5)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append(" ".join(copy))
    rows += ["", None, "one", "One", "one two", "one two", "\n\t "]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id bigint, text string, component_id bigint")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(docs, k=k, percent=percent).collect()}
    assert got == brute_components(rows, k, percent)


def test_near_components_in_many_tiles(spark, monkeypatch):
    """Buckets of several components, parts of few nodes and bytes, and one very long text among them."""
    monkeypatch.setattr(near_dedup, "TILE", 6)
    monkeypatch.setattr(near_dedup, "TILE_BYTES", 4000)
    rng = random.Random(21)
    base = [f"w{n}" for n in range(60)]
    rows = []
    for k in range(90):  # a drifting chain: neighbours are alike, distant ones only share some words
        base[rng.randrange(60)] = f"x{k}"
        rows.append(" ".join(base))
    long = [f"w{n % 60}y{n}" for n in range(6000)]
    rows += [" ".join(long), " ".join([*long[:-40], *(f"z{n}" for n in range(40))]), " ".join(base[:30])]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for percent in (85, 93):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_components(docs, k=3, percent=percent, bands=48, rows=3).collect()}
        assert got == brute_components(rows, 3, percent)


def test_near_components_on_messy_rows(spark):
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in near_dedup.near_components(messy(spark), k=3, percent=85).collect()}
    assert got[1, 1] == (1, True) and got[9, 1] == (1, False) and got[3, 0] == (3, True) and got[4, 0] == (4, True) and got[6, 5] == (5, False) and got[None, 1] == (None, False)
    assert near_dedup.near_components(messy(spark).limit(0)).count() == 0


def test_pruning_keeps_what_it_promises():
    for n, least in near_dedup.matches_needed(160, 0.85, 1e-4):
        rng = np.random.default_rng(1)
        found = rng.binomial(n, rng.uniform(0.85, 1, 400_000))
        assert (found < least).mean() < 1e-3
    same = near_dedup.signature(np.arange(1, 50, dtype=np.uint64) << np.uint64(40), 160)
    assert list(near_dedup.plausible(same, np.stack([same, same[::-1]]), near_dedup.matches_needed(160, 0.85, 1e-4))) == [0]


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)] + [(500, k) for k in range(400, 500)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    root = {x: x for ab in links for x in ab}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if x != r}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


GOOD = "This is a sentence with some words in it that goes on for a while. "


def test_quality_rules(spark):
    rng = random.Random(2)
    prose = "\n".join(" ".join(f"word{rng.randrange(10**6)}" for _ in range(8)) + "." for _ in range(12))
    rows = [(1, prose, "x"), (2, None, "x"), (3, GOOD * 9, "x"), (4, "\n".join("Menu | Home | News | About | More | Even more | And more %%% $$$ " + str(k) for k in range(20)), "x"), (5, prose.upper(), "x"), (6, prose + "\n" + prose, "x"), (7, prose + "\nAccept cookies.", "x"), (8, LONG, "x")]
    docs = spark.createDataFrame([(*r, "old") for r in rows], DOCS + ", quality string")
    got = {r.doc_id: r.quality for r in quality_rules(docs).collect()}
    assert {i for i, q in got.items() if q.kept} == {1, 7}
    assert got[7].cleaned == prose and got[2].n_words == 0 and got[2].base_failed and got[2].cleaned == ""
    assert got[6].n_dup_lines == 12 and got[4].n_symbols == 20 * 12 and got[8].n_repeat_words == got[8].n_words == 100000
    assert quality_rules(docs.limit(0)).count() == 0


def test_quality_of_very_long_lines(spark):
    line = "Some words of one line that never ends, " * 40_000
    rows = [(1, line), (2, line + "."), (3, "| " * 500_000 + "."), (4, "A" * 1_000_000)]
    got = {r.doc_id: r.quality for r in quality_rules(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[1].n_words == 320_000 and got[1].base_failed and got[2].cleaned == line + "." and got[3].cleaned == "" and got[4].cleaned == "" and got[3].n_symbols == 500_000


def test_lines_of_menus_and_notices(spark):
    from pyspark.sql import functions as F

    from folioscan.llm.quality import line_passes

    lines = {
        "He found it in the catalog inside.": True, "Please log in.": False, "We use cookies here.": False, "Cookiesheets are made of steel.": True, "Mentions légales.": False, "Das Impressum.": False,
        "Home · News · About · More.": False, "This is a long sentence · with marks between its parts · as some poets like it · when they write much text into one line.": True, "A | B.": False, "Plain words here.": True,
    }
    found = spark.createDataFrame([(x,) for x in lines], "line string").select("line", line_passes(F.col("line")).alias("ok")).collect()
    assert {r.line: r.ok for r in found} == lines


def test_repeated_words_against_brute_force(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 14))) for _ in range(300)]
    got = [r[0] for r in quality_rules(spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)).select("quality.n_repeat_words").collect()]

    def brute(t):
        w = t.split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({p for i, g in enumerate(grams) if grams.count(g) > 1 for p in (i, i + 1, i + 2)})

    assert got == [brute(t) for t in texts]
