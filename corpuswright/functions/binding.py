"""Values that a column expression uses more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once for each row however often `use` names it. Within a lambda
    a column that does not depend on its argument would be computed anew for every element,
    which makes the work follow the square of the array's length."""
    return F.transform(F.array(value), use)[0]


def in_any(words: Column, others: Column) -> Column:
    """Those of `words` (repeats included) that occur in `others`. The common words are dealt to
    about root-many hash buckets and each word looks through its own, so the work is far below
    the product of the sizes."""

    def pick(both: Column) -> Column:
        n = both["n"]
        place = lambda w: F.pmod(F.hash(w), n)
        dealt = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.filter(both["common"], lambda w: place(w) == k))
        return bind(dealt, lambda d: F.filter(both["words"], lambda w: F.array_contains(F.get(d, place(w)), w)))

    common = F.array_intersect(words, others)
    n = F.greatest(F.ceil(F.sqrt(F.size(words).cast("double"))), F.lit(1)).cast("int")
    return bind(F.struct(words.alias("words"), common.alias("common"), n.alias("n")), pick)


def runs_of(words: Column, n: int) -> Column:
    """All runs of n words, joined by a blank; none for fewer words."""
    return bind(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))))
