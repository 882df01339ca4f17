"""How often a phrase stands in a document, from the places of its terms.

Each term's places vote for the starts that put it in order, and for those before, so
matches are intersections and unions of number arrays: one pass over each array, within
the row that holds them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def phrase_frequency(terms: tuple[str, ...], positions: dict[str, Column]) -> Column:
    """Sum of 1 / (1 + displacement) over matches with at most one displacement.

    ``positions`` has each term's places, none of them null. A start counts once if every term
    stands at its place after it or one later, one at least at its place, on as many
    different places as there are terms; it counts half unless all stand at theirs.
    """
    n = len(terms)
    starts = lambda i, by: F.transform(positions[terms[i]], lambda p: p - by)
    exact = [starts(i, i) for i in range(n)]
    near = [F.array_union(exact[i], starts(i, i + 1)) for i in range(n)]
    whole = reduce(F.array_intersect, exact)
    found = F.array_intersect(reduce(F.array_intersect, near), reduce(F.array_union, exact))
    if len(set(terms)) < n:
        found = F.element_at(F.transform(F.array(found), lambda f: _on_places_enough(f, n, starts)), 1)
    return F.size(whole) + (F.size(found) - F.size(whole)) / 2


def _on_places_enough(found: Column, n: int, starts) -> Column:
    """Of ``found``, the starts of which at most one of the n + 1 places after them has no
    term that may stand there."""
    held = [F.array_union(starts(o, o), starts(o - 1, o)) if 0 < o < n else starts(min(o, n - 1), o) for o in range(n + 1)]
    return reduce(F.array_union, [reduce(F.array_intersect, held[:k] + held[k + 1 :], found) for k in range(n + 1)])
