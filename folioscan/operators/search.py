"""Keyword search: matching, scoring, filters, ranking and snippets.

A word of letters and digits lies within one term exactly when it lies in the
lower-cased text, so such words are matched by one scan without analysing texts.
Only patterns with wildcards and phrases analyse, and only texts that hold their
plain parts. A large corpus with many queries is served from postings instead.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscan import schema as S
from folioscan.functions.analysis import TOKEN, analysed, dictionary, tokens, wildcard_regex
from folioscan.functions.phrases import phrase_frequency
from folioscan.operators.segments import Reader
from folioscan.plans.query import Infix, Phrase, QueryPlan, SearchOptions, parse_query
from folioscan.sources.shared import new_path

#: Documents of a term that are broadcast to others' postings, and blocks read in a round.
BROADCAST_DOCUMENTS, MOST_BLOCKS = 200_000, 8_192
RESULT = ("file_path", "file_name", "folder_path", "file_size", "last_modified", "file_type")


def _holds(text: Column, pattern: Infix, analyser: str) -> Column:
    """Whether a term of ``text`` holds the pattern."""
    low = F.lower(analysed(text))
    plain_word = all(c.isalnum() or c == "_" for c in pattern.pattern)
    if pattern.plain and (plain_word or analyser == "whole"):
        return low.contains(pattern.pattern)
    parts = [p for p in re.split(r"[*?]+", pattern.pattern) if p]
    found = F.exists(tokens(text, analyser), lambda t: t.rlike(wildcard_regex(f"*{pattern.pattern}*")))
    for part in parts:
        found = low.contains(part) & found
    return found


def filters(options: SearchOptions) -> Column:
    """The conditions of the options that don't depend on the query."""
    out = F.lit(True)
    if options.file_types:
        out &= F.col("file_type").isin(list(options.file_types))
    if options.date_from is not None:
        out &= F.col("last_modified") >= F.lit(options.date_from)
    if options.date_to is not None:
        out &= F.col("last_modified") <= F.lit(options.date_to)
    if options.folder:
        out &= F.col("folder_path").startswith(options.folder)
    return out


def phrase_frequencies(docs: DataFrame, phrase: Phrase, analyser: str, key: str = "file_path") -> DataFrame:
    """key, freq (sum of 1 / (1 + displacement) over matches) and length (terms) of
    the documents that hold the phrase with at most one displacement.

    Only texts that hold every term are looked at. Under the plain analyser a phrase of
    different terms matches where they stand side by side, or with one other term
    between two of them. All others are matched by the places of their terms.
    """
    low = F.lower(analysed(F.col("content")))
    here = docs
    for term in set(phrase.terms):
        here = here.where(low.contains(term))
    if analyser == "unicode" and len(set(phrase.terms)) == len(phrase.terms):
        close, wide = phrase_regex(phrase.terms)
        counts = here.select(key, (F.regexp_count(low, F.lit(f"(?={close})")) + F.regexp_count(low, F.lit(f"(?={wide})(?!{close})")) / 2).cast("double").alias("freq"), low.alias("low"))
        return counts.where("freq > 0").select(key, F.regexp_count("low", F.lit(TOKEN)).alias("length"), "freq")
    terms = here.select(key, tokens(F.col("content"), analyser).alias("terms"))
    at = lambda t: F.array_compact(F.transform("terms", lambda x, i: F.when(x == t, i)))
    placed = terms.select(key, F.size("terms").alias("length"), *[at(t).alias(f"p{i}") for i, t in enumerate(sorted(set(phrase.terms)))])
    places = {t: F.col(f"p{i}") for i, t in enumerate(sorted(set(phrase.terms)))}
    return placed.select(key, "length", phrase_frequency(phrase.terms, places).alias("freq")).where("freq > 0")


def _scoring(plan: QueryPlan, phrases: set[int]) -> tuple[Column, Column, Column]:
    """Score, its norm's square, and whether all words match, from the flags c, f, ec
    and ef of each word, and freq, length and idf of each phrase."""
    on = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
    norm, score, every = F.lit(0.0), F.lit(0.0), F.lit(True)
    for k, word in enumerate(plan.words):
        c, f = on(f"c{k}"), on(f"f{k}")
        weight, own = F.lit(1.0), c
        if k in phrases:
            weight = F.pow(F.col(f"idf{k}"), 2)
            own = F.coalesce(F.sqrt(f"freq{k}") * weight / F.sqrt(F.col(f"length{k}").cast("double")), F.lit(0.0))
        norm += on(f"ec{k}") * weight + on(f"ef{k}") * (S.FILE_NAME_BOOST**2)
        score += (c + f) / 2 * (own + S.FILE_NAME_BOOST * f)
        every &= (c + f) > 0
    return score, norm, every


def matches(docs: DataFrame, plan: QueryPlan, options: SearchOptions | None = None, analyser: str = "unicode") -> DataFrame:
    """``docs`` that match, with a score.

    A word's clauses are content and file name; each counts if any document of the
    index has it, filters aside. The score is queryNorm times the sum over words of
    (clauses hit / 2) * (content score + 2.5 * name hit).
    """
    options = options or SearchOptions()
    if plan.blank:
        return docs.withColumn("score", F.lit(0.0)).limit(0)
    if not plan.words:
        return docs.where(filters(options)).withColumn("score", F.lit(1.0))
    flagged, exists = docs, []
    phrases = {}
    for k, word in enumerate(plan.words):
        if isinstance(word.content, Phrase):
            found = phrase_frequencies(docs, word.content, analyser)
            terms = F.array(*[F.lit(t) for t in word.content.terms])
            low = F.lower(analysed(F.col("content")))
            term = lambda t: low.rlike(_term_regex(t)) if analyser == "unicode" else F.array_contains(tokens(F.col("content"), analyser), t)
            holds = lambda t: F.when(low.contains(t), term(t)).otherwise(False)
            counts = docs.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(holds(t)).alias(f"df{i}") for i, t in enumerate(word.content.terms)])
            idf = sum((1 + F.log((F.col("n").cast("double")) / (F.col(f"df{i}") + 1)) for i in range(len(word.content.terms))), F.lit(0.0))
            phrases[k] = counts.select(idf.alias(f"idf{k}"))
            flagged = flagged.join(found.select("file_path", F.col("freq").alias(f"freq{k}"), F.col("length").alias(f"length{k}")), "file_path", "left")
            flagged = flagged.withColumn(f"c{k}", F.col(f"freq{k}").isNotNull())
        else:
            flagged = flagged.withColumn(f"c{k}", _holds(F.col("content"), word.content, analyser))
        flagged = flagged.withColumn(f"f{k}", _holds(F.col("file_name"), word.name, analyser))
        exists += [F.max(f"c{k}").alias(f"ec{k}"), F.max(f"f{k}").alias(f"ef{k}")]
    stats = flagged.agg(*exists)  # one row
    for one in phrases.values():
        stats = stats.crossJoin(one)  # one row each
    score, norm, every = _scoring(plan, set(phrases))
    hits = flagged.where(every & filters(options)).crossJoin(F.broadcast(stats))
    return hits.withColumn("score", score / F.sqrt(norm)).select(*docs.columns, "score")


def search(docs: DataFrame, query: str | None, options: SearchOptions | None = None, analyser: str = "unicode") -> DataFrame:
    """The best documents by score, ties by path, without their contents."""
    options = options or SearchOptions()
    found = matches(docs, parse_query(query, analyser), options, analyser)
    return found.select(*RESULT, "score").orderBy(F.desc("score"), "file_path").limit(options.max_results)


def total_hits(docs: DataFrame, query: str | None, options: SearchOptions | None = None, analyser: str = "unicode") -> DataFrame:
    """One row: the number of matching documents, whatever the limit."""
    return matches(docs, parse_query(query, analyser), options, analyser).agg(F.count(F.lit(1)).alias("total_hits"))


WORD = r"[\p{L}\p{M}\p{N}_]"


def _term_regex(term: str) -> str:
    """A term of the analyser by itself, as a regular expression."""
    quoted = re.escape(term)
    return rf"(?<!{WORD}){quoted}(?!{WORD})" if re.match(r"\w", term) else quoted


def phrase_regex(terms: tuple[str, ...]) -> tuple[str, str]:
    """A phrase's terms side by side, and with one other term between two of them."""
    own, other = [_term_regex(t) for t in terms], rf"\s*(?:(?<!{WORD}){WORD}+(?!{WORD})|[^\s\p{{L}}\p{{M}}\p{{N}}_])\s*"
    wide = ["".join(t + ("" if i == len(own) - 1 else other if i == gap else r"\s*") for i, t in enumerate(own)) for gap in range(len(own) - 1)]
    return r"\s*".join(own), "|".join(wide)


def _mark_regex(word: Infix | Phrase) -> str:
    """What a word marks in a text: the phrase, or the part of a term that the pattern fits."""
    if isinstance(word, Phrase):
        return "(?iu)(?:" + "|".join(phrase_regex(word.terms)) + ")"
    return "(?iu)" + "".join(f"{WORD}*" if c == "*" else WORD if c == "?" else re.escape(c) for c in word.pattern)


def snippets(docs: DataFrame, query: str, options: SearchOptions | None = None, analyser: str = "unicode") -> DataFrame:
    """Up to five fragments with a match of the query's words, for the best documents:
    file_path, fragment, text, highlight_start, highlight_end (exclusive).

    A match belongs to the fragment of 100 characters in which it starts, and the
    fragment is longer if the match passes its end; the first match of a fragment is
    marked. Phrases and wildcards mark what they match.
    """
    options = options or SearchOptions()
    words = list(dict.fromkeys(_mark_regex(w.content) for w in parse_query(query, analyser).words))
    best = docs.join(search(docs, query, options, analyser).select("file_path"), "file_path", "left_semi").select("file_path", analysed(F.col("content")).alias("content"))
    if options.skip_highlights or not words:
        best, words = best.limit(0), ["x"]
    found = None
    for word in words:
        hits = F.regexp_extract_all("content", F.lit(word), F.lit(0))
        gaps = best.select("file_path", F.posexplode(F.arrays_zip(F.slice(F.split("content", word, -1), F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"))).alias("n", "x"))
        before = Window.partitionBy("file_path").orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        size = F.length("x.hit")
        marks = gaps.select("file_path", (F.sum(F.length("x.gap") + size).over(before) - size).alias("start"), size.cast("bigint").alias("size"))
        found = marks if found is None else found.unionByName(marks)
    grid = F.floor(F.col("start") / S.FRAGMENT_CHARS).cast("bigint")
    first = found.groupBy("file_path", grid.alias("fragment")).agg(F.min(F.struct("start", "size")).alias("m"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("file_path").orderBy("fragment"))).where(F.col("k") <= S.MAX_FRAGMENTS)
    start = F.col("m.start") - F.col("fragment") * S.FRAGMENT_CHARS
    end = start + F.col("m.size")
    text = F.substring(F.col("content"), (F.col("fragment") * S.FRAGMENT_CHARS + 1).cast("int"), F.greatest(F.lit(S.FRAGMENT_CHARS).cast("bigint"), end).cast("int"))
    return first.join(best, "file_path").select("file_path", "fragment", text.alias("text"), start.alias("highlight_start"), end.alias("highlight_end"))


def term_documents(posted: DataFrame, pattern: str, field: str = "content", key: str = "file_path") -> DataFrame:
    """The documents with a term that holds ``pattern``, from postings: the pattern
    picks terms in the dictionary, and these pick postings."""
    terms = dictionary(posted, key).where((F.col("field") == field) & F.col("term").rlike(wildcard_regex(f"*{pattern}*"))).select("term")
    return posted.where(F.col("field") == field).join(terms, "term", "left_semi").select(key).distinct()


def pinned(index) -> Reader:
    """A reader of an index's newest version, or the reader that was given."""
    return index if isinstance(index, Reader) else index.at()


class _Indexed:
    """A plan's words over one version of an index: which terms they pick, what a document
    scores, and what its norm is."""

    def __init__(self, reader: Reader, plan: QueryPlan):
        self.reader, self.plan = reader, plan
        self.phrases = {k: w.content for k, w in enumerate(plan.words) if isinstance(w.content, Phrase)}
        picks = [(f"f{k}", "filename", w.name) for k, w in enumerate(plan.words)] + [(f"c{k}", "content", w.content) for k, w in enumerate(plan.words) if k not in self.phrases]
        rows = [reader.terms_with(pattern, field).select(F.lit(flag).alias("flag"), "field", "term") for flag, field, pattern in picks]
        self.terms, self.flags = reduce(DataFrame.unionByName, rows), [flag for flag, _, _ in picks]
        self.counts = {k: reader.document_counts("content", sorted(set(p.terms))) for k, p in self.phrases.items()}
        n = reader.total() if self.phrases else 0
        self.idf = {k: sum(1 + math.log(n / (self.counts[k][t] + 1)) for t in p.terms) if n else 0.0 for k, p in self.phrases.items()}

    def flagged(self, only: list[str] | None = None) -> DataFrame:
        """file_path and flag of documents with a term that a flag's pattern picks."""
        terms = self.terms if only is None else self.terms.where(F.col("flag").isin(only))
        return self.reader.grouped(terms).select("file_path", "field", "term").join(terms, ["field", "term"]).select("file_path", "flag").distinct()

    def phrase(self, k: int, candidates: DataFrame | None = None) -> DataFrame:
        """file_path, freq and length of documents with a phrase, of all or of candidates.

        Places of the phrase's terms meet in one row per document; only documents that have
        its rarest term are moved."""
        phrase, counts = self.phrases[k], self.counts[k]
        terms = sorted(set(phrase.terms), key=lambda t: (counts[t], t))
        rows = self.reader.places_of("content", terms).select("file_path", "term", "length", "positions")
        few = candidates
        if few is None and counts[terms[0]] * 2 < sum(counts.values()) / len(terms):
            few = self.reader.places_of("content", terms[:1]).select("file_path")
            few = F.broadcast(few) if counts[terms[0]] <= BROADCAST_DOCUMENTS else few
        rows = rows if few is None else rows.join(few, "file_path", "left_semi")
        own = rows.groupBy("file_path").agg(F.max("length").alias("length"), *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms)])
        for i in range(len(terms)):
            own = own.where(F.col(f"p{i}").isNotNull())
        freq = phrase_frequency(phrase.terms, {t: F.col(f"p{i}") for i, t in enumerate(terms)})
        return own.select("file_path", "length", freq.cast("double").alias("freq")).where("freq > 0")

    def scored(self, hits: DataFrame) -> DataFrame:
        """file_path and score, before the norm, of documents that all words match, from
        ``hits`` (file_path, flag, freq, length)."""
        columns = []
        for k in range(len(self.plan.words)):
            columns += [F.max(F.col("flag") == f"{x}{k}").alias(f"{x}{k}") for x in "cf"]
            columns += [F.max(F.when(F.col("flag") == f"c{k}", F.col(x))).alias(f"{x}{k}") for x in ("freq", "length")]
        rows = hits.groupBy("file_path").agg(*columns).withColumns({f"idf{k}": F.lit(x) for k, x in self.idf.items()})
        score, _, every = _scoring(self.plan, set(self.phrases))
        return rows.where(every).select("file_path", score.alias("raw"))

    def hits(self, plain: DataFrame, phrases: dict[int, DataFrame]) -> DataFrame:
        """Rows for ``scored`` of flagged documents and of those with phrases."""
        out = plain.select("file_path", "flag", F.lit(None).cast("double").alias("freq"), F.lit(None).cast("int").alias("length"))
        for k, found in phrases.items():
            out = out.unionByName(found.select("file_path", F.lit(f"c{k}").alias("flag"), "freq", "length"))
        return out

    def norm(self, phrases: dict[int, DataFrame | bool]) -> DataFrame:
        """One row: the norm of scores, from which clauses any document has."""
        one = self.terms.agg(*[(F.count_if(F.col("flag") == f) > 0).alias(f"e{f}") for f in self.flags]).withColumns({f"idf{k}": F.lit(x) for k, x in self.idf.items()})
        for k, found in phrases.items():
            one = one.withColumn(f"ec{k}", F.lit(found)) if isinstance(found, bool) else one.crossJoin(found.agg((F.count(F.lit(1)) > 0).alias(f"ec{k}")))  # one row each
        square = F.lit(0.0)
        on = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("double")
        for k in range(len(self.plan.words)):
            square += on(f"ec{k}") * (F.pow(F.col(f"idf{k}"), 2) if k in self.phrases else F.lit(1.0)) + on(f"ef{k}") * (S.FILE_NAME_BOOST**2)
        return one.select(F.sqrt(square).alias("norm"))


def search_index(index, query: str | None, options: SearchOptions | None = None) -> DataFrame:
    """``search`` answered from an index's postings, for large corpora; ``index`` is an
    index, whose newest version is read, or a reader of one.

    Trigrams and the dictionary say which terms a word's pattern picks, and only their
    buckets of postings are read; documents are read without their contents.
    """
    options, reader = options or SearchOptions(), pinned(index)
    plan = parse_query(query, reader.analyser)
    docs = reader.docs().select(*RESULT)
    if plan.blank or not plan.words:
        return docs.where(F.lit(not plan.blank) & filters(options)).withColumn("score", F.lit(1.0)).orderBy("file_path").limit(options.max_results)
    words = _Indexed(reader, plan)
    phrases = {k: words.phrase(k) for k in words.phrases}
    ranked = words.scored(words.hits(words.flagged(), phrases)).join(docs.where(filters(options)), "file_path").crossJoin(F.broadcast(words.norm(phrases)))
    return ranked.select(*RESULT, (F.col("raw") / F.col("norm")).alias("score")).orderBy(F.desc("score"), "file_path").limit(options.max_results)


def search_topk(index, query: str | None, options: SearchOptions | None = None, first_blocks: int = 8) -> tuple[DataFrame, dict]:
    """``search_index`` that stops when no further document can be among the best, and
    what it read: blocks, blocks_read, rounds.

    Postings lie in blocks of documents with like impact (a term's share of a document's
    terms), and each block's largest one bounds what a phrase scores in it. Documents with a
    word in their names are scored first, since no bound holds for them. Then the blocks of
    the phrase's rarest term are read from the largest impact down, four times as many in each
    round, until the last of the best so far is above what the next block could give.
    Queries of other than one phrase and any words are answered in full.
    """
    options, reader = options or SearchOptions(), pinned(index)
    plan = parse_query(query, reader.analyser)
    if sum(isinstance(w.content, Phrase) for w in plan.words) != 1:
        return search_index(reader, query, options), {"blocks": 0, "blocks_read": 0, "rounds": 0}
    words = _Indexed(reader, plan)
    k = next(iter(words.phrases))
    term = min(sorted(set(words.phrases[k].terms)), key=lambda t: (words.counts[k][t], t))
    blocks = reader.blocks("content", term)
    docs = reader.docs().select(*RESULT).where(filters(options))
    of_names, of_texts = [f for f in words.flags if f[0] == "f"], [f for f in words.flags if f[0] == "c"]

    def kept(df: DataFrame) -> DataFrame:
        path = new_path(reader.spark, "topk")
        df.write.parquet(path)
        return reader.spark.read.schema(df.schema).parquet(path)

    def best_of(flagged: DataFrame, found: DataFrame, so_far: DataFrame | None) -> DataFrame:
        rows = words.scored(words.hits(flagged, {k: found})).join(docs, "file_path").select(*RESULT, "raw")
        rows = rows if so_far is None else rows.unionByName(so_far)
        return kept(rows.orderBy(F.desc("raw"), "file_path").limit(options.max_results))

    def bound(impact: float) -> float:
        # a place serves one exact start and one half start at most, so a phrase comes
        # 1.5 times as often as each of its terms at most; other words add half a point
        return 0.5 * (len(plan.words) - 1) + 0.5 * math.sqrt(1.5 * impact) * words.idf[k] ** 2

    named = kept(words.flagged(of_names).select("file_path").distinct())
    found = kept(words.phrase(k, named))
    best, any_found = best_of(words.flagged().join(named, "file_path", "left_semi"), found, None), bool(found.limit(1).count())
    order = [F.desc("impact"), "segment", "block"]
    told, after, step = {"blocks": blocks.count(), "blocks_read": 0, "rounds": 0}, None, first_blocks
    while True:
        left = blocks if after is None else blocks.where((F.col("impact") < after["impact"]) | (F.col("impact") == after["impact"]) & ((F.col("segment") > after["segment"]) | (F.col("segment") == after["segment"]) & (F.col("block") > after["block"])))
        turn = left.orderBy(*order).limit(step).collect()
        if not turn:
            break
        last = best.agg(F.count(F.lit(1)).alias("n"), F.min("raw").alias("raw")).first()
        if any_found and last["n"] >= options.max_results and bound(turn[0]["impact"]) < last["raw"]:
            break
        asked = kept(reader.places_of("content", [term], [(r["segment"], r["block"]) for r in turn]).select("file_path").join(named, "file_path", "left_anti"))
        found = kept(words.phrase(k, asked))
        best = best_of(words.flagged(of_texts).join(asked, "file_path", "left_semi"), found, best)
        any_found = any_found or bool(found.limit(1).count())
        told = {**told, "blocks_read": told["blocks_read"] + len(turn), "rounds": told["rounds"] + 1}
        after, step = turn[-1], min(4 * step, MOST_BLOCKS)
    ranked = best.crossJoin(F.broadcast(words.norm({k: any_found})))
    return ranked.select(*RESULT, (F.col("raw") / F.col("norm")).alias("score")).orderBy(F.desc("score"), "file_path").limit(options.max_results), told
