"""Quality rules, lines first, with DataFrame functions only.

Each line is held against rules for its ending, its symbols, its letters, the
separators of menus, stock phrases of menus and notices, and repetition. Lines that fail go; a document that
loses more than a share of its characters this way is rejected. Document-wide
counts (words, symbols, repeated windows of three words) come from the whole text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscan.llm.shared import SPACE, let

#: Symbols that prose has few of.
SYMBOLS = "[#*$%&|<>]"
#: Phrases of menus, notices and code stubs in four languages, as whole words; counted
#: only in short lines.
STOCK_PHRASES = (
    "all rights reserved",
    "cookies?",
    "enable javascript",
    "lorem ipsum",
    "privacy policy",
    "sign up",
    "log in",
    "terms of service",
    "terms of use",
    "click here",
    "alle rechte vorbehalten",
    "datenschutz",
    "impressum",
    "hier klicken",
    "tous droits réservés",
    "politique de confidentialité",
    "mentions légales",
    "cliquez ici",
    "todos los derechos reservados",
    "política de privacidad",
    "aviso legal",
    "haga clic aquí",
)
STOCK = r"(^|[^\p{L}\p{N}_])(" + "|".join(STOCK_PHRASES) + r")([^\p{L}\p{N}_]|$)"
#: What stands between the entries of a menu or a trail, whatever the language.
SEPARATORS = "[|·•»›→]"
#: How a sentence ends, closing marks and white space after it allowed.
SENTENCE_END = rf"[.!?:;…。！？][\"'’”»)\]]*[{SPACE}]*\z"


def line_passes(line: Column, max_symbol_share: float = 0.05, stock_chars: int = 200, entry_chars: int = 30) -> Column:
    """Whether a line is prose: it ends as a sentence does, symbols are at most
    ``max_symbol_share`` of its characters, it isn't all capitals, it isn't a short line
    (up to ``stock_chars``) with a stock phrase, and no list of four entries or more
    between separators, of ``entry_chars`` on average at most."""
    symbols = F.size(F.split(line, SYMBOLS)) - 1
    shouted = ~line.rlike(r"\p{Ll}") & line.rlike(r"(\p{Lu}[^\p{Ll}]*){3}")
    stock = (F.length(line) <= stock_chars) & F.lower(line).rlike(STOCK)
    entries = F.size(F.split(line, SEPARATORS))
    listed = (entries >= 4) & (F.length(line) <= entry_chars * entries)
    return line.rlike(SENTENCE_END) & (symbols <= max_symbol_share * F.length(line)) & ~shouted & ~stock & ~listed


def repeated_words(words: Column) -> Column:
    """Words that lie in a window of three words found at least twice in ``words``.

    Windows are compared by 64-bit hash. Sorting puts equal windows side by side;
    the windows that have an equal neighbour then cover their words.
    """
    pair = lambda x, i: F.struct(x.alias("h"), i.alias("i"))

    def covered(places: Column) -> Column:
        reach = F.transform(places, lambda p, j: F.least(F.lit(3), F.coalesce(F.get(places, j + 1) - p, F.lit(3))))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    def twice(ordered: Column) -> Column:
        same = lambda e, j: F.get(ordered, j)["h"].eqNullSafe(e["h"])
        found = F.filter(ordered, lambda e, j: same(e, j - 1) | same(e, j + 1))
        return let(F.array_sort(F.transform(found, lambda e: e["i"])), covered)

    def counted(hashes: Column) -> Column:
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(let(F.array_sort(F.transform(hashes, pair)), twice))

    windows = F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return F.when(F.size(words) < 4, 0).otherwise(let(windows, counted))


def quality_rules(docs: DataFrame, text_col: str = "text", min_words: int = 50, max_repeat_percent: int = 50, max_lost_percent: int = 50) -> DataFrame:
    """``docs`` with a struct column ``quality`` added (it replaces one of that name).

    Fields: n_words, word_chars (code points in words), n_symbols, n_dup_lines
    (lines with a word that equal an earlier line), n_repeat_words (words in
    windows of three words found twice or more), all long; base_failed (under
    ``min_words``, or more than ``max_repeat_percent`` of the words repeat); kept
    (not base_failed, and at most ``max_lost_percent`` of the characters in lines
    with a word are lost to failing or repeated lines); cleaned (the passing lines,
    each once, joined by newlines).

    A null text counts as empty: all counts are 0, base_failed holds. Texts and lines may
    be of any length. Row for row: repeated rows give repeated answers, and no rows give
    no rows.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    chars = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    of_words = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), chars(w).alias("word_chars"), repeated_words(w).cast("long").alias("n_repeat_words")))

    def of_distinct(xs: Column, once: Column) -> Column:
        good = F.filter(once, lambda x: line_passes(x))
        return let(good, lambda g: F.struct((F.size(xs) - F.size(once)).cast("long").alias("n_dup_lines"), chars(xs).alias("chars"), chars(g).alias("good"), F.array_join(g, "\n").alias("cleaned")))

    of_lines = let(lines, lambda xs: let(F.array_distinct(xs), lambda once: of_distinct(xs, once)))
    # each let() is one expression, so its value is computed once per row
    return (
        docs.withColumn("quality", F.struct(of_words.alias("w"), of_lines.alias("l"), (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("n_symbols")))
        .withColumn("quality", let(F.col("quality"), lambda q: F.struct(
            q["w"]["n_words"].alias("n_words"), q["w"]["word_chars"].alias("word_chars"), q["n_symbols"].alias("n_symbols"), q["l"]["n_dup_lines"].alias("n_dup_lines"), q["w"]["n_repeat_words"].alias("n_repeat_words"),
            ((q["w"]["n_words"] < min_words) | (100 * q["w"]["n_repeat_words"] > max_repeat_percent * q["w"]["n_words"])).alias("base_failed"),
            (100 * (q["l"]["chars"] - q["l"]["good"]) <= max_lost_percent * q["l"]["chars"]).alias("lines_kept"), q["l"]["cleaned"].alias("cleaned"))))
        .withColumn("quality", let(F.col("quality"), lambda q: F.struct(
            *[q[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], (~q["base_failed"] & q["lines_kept"]).alias("kept"), q["cleaned"].alias("cleaned"))))
    )
