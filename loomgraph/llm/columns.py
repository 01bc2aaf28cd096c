"""Column expressions that several native operators use."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of a block, from which stretches of a long text are taken.
BLOCK = 4096


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda's variable, where an expression would be computed at each place it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def scan(items: Column, zero: Column, emitted: str, step: Callable[[Column, Column], tuple[Column, Column]], levels: int = 2) -> Column:
    """What step emits, in order: step(state, item) gives the next state and an array of the type emitted.

    Arrays can't be appended to in place. Items are taken in blocks, and these in blocks, so
    n of them copy some n^(4/3) references, and not n^2.
    """
    none = F.array().cast(emitted)

    def inner(acc: Column, x: Column) -> Column:
        state, out = step(acc["state"], x)
        return F.struct(state.alias("state"), F.concat(acc["out"], out).alias("out"))

    def run(xs: Column, state: Column, level: int) -> Column:
        start = F.struct(state.alias("state"), none.alias("out"))
        if not level:
            return F.aggregate(xs, start, inner)

        def blocks(width: Column) -> Column:
            def outer(acc: Column, k: Column) -> Column:
                part = let(F.slice(xs, k * width + 1, width), lambda ys: run(ys, acc["state"], level - 1))
                return let(part, lambda y: F.struct(y["state"].alias("state"), F.concat(acc["out"], y["out"]).alias("out")))

            return F.aggregate(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / width).cast("int")), start, outer)

        width = F.ceil(F.pow(F.size(xs).cast("double"), F.lit(level / (level + 1.0)))).cast("int")
        return let(F.greatest(F.lit(8), width), blocks)

    return let(items, lambda xs: F.when(F.size(xs) > 0, run(xs, zero, levels)["out"]).otherwise(none))


def cutter(text: Column, body: Callable[[Callable[[Column, Column], Column]], Column]) -> Column:
    """body(cut), where cut(a, b) is the text's code points from a to b, b exclusive. It reads a block or two of a long text, not all before."""

    def one(a: Column, b: Column, parts: Column) -> Column:
        i, j = F.floor(a / BLOCK).cast("int"), F.floor(b / BLOCK).cast("int")
        head = lambda k, x: F.get(parts, k).substr(x % BLOCK + 1, F.lit(BLOCK))
        tail = F.coalesce(F.get(parts, j).substr(F.lit(1), b % BLOCK), F.lit(""))
        within = F.get(parts, i).substr(a % BLOCK + 1, b - a)
        across = F.concat(head(i, a), F.array_join(F.slice(parts, i + 2, j - i - 1), ""), tail)
        return F.when(b <= a, F.lit("")).when(i == j, within).otherwise(across)

    pieces = F.when(F.length(text) <= BLOCK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)))
    return let(pieces, lambda parts: body(lambda a, b: one(a, b, parts)))
