"""One rule to one DataFrame plan.

Each atom is a scan whose columns are its variables; atoms sharing variables are joined on
them, connected ones first, and an atom that brings nothing the rest needs is a semi-join.
Variables are dropped as soon as nothing later uses them. Join algorithms, order of
build sides and skew are left to Catalyst and adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.plans.ir import Atom, Const, Rule

#: The columns of relations with one, two and three arguments.
COLUMNS = {1: ("s",), 2: ("s", "o"), 3: ("s", "p", "o")}
#: (position in the body, atom) to its relation, whose rows may repeat.
Lookup = Callable[[int, Atom], DataFrame]


def scan(atom: Atom, relation: DataFrame) -> DataFrame:
    """Constants become filters, a repeated variable the diagonal, and variables the columns."""
    first: dict[str, str] = {}
    for column, term in zip(COLUMNS[len(atom.args)], atom.args, strict=True):
        if isinstance(term, Const):
            relation = relation.filter(F.col(column) == term.value)
        elif term.name in first:
            relation = relation.filter(F.col(column) == F.col(first[term.name]))
        else:
            first[term.name] = column
    if not first:
        return relation.select(F.lit(True).alias("__exists")).limit(1)
    return relation.select(*[F.col(c).alias(f"v_{v}") for v, c in first.items()])


def order(rule: Rule, first: int | None, sizes: dict[tuple[str, int], int] | None = None) -> list[int]:
    """Delta first, then what is connected, with more constants or fewer known rows before the rest."""
    left = list(range(len(rule.body)))
    sizes = sizes or {}

    def weight(i: int) -> tuple:
        a = rule.body[i]
        return (-sum(isinstance(t, Const) for t in a.args), sizes.get(a.key, 1 << 40), i)

    done = [first if first is not None else min(left, key=weight)]
    left.remove(done[0])
    bound = set(rule.body[done[0]].variables())
    while left:
        i = min(left, key=lambda i: (not rule.body[i].variables(), not bound & set(rule.body[i].variables()), -len(bound & set(rule.body[i].variables())), weight(i)))
        left.remove(i)
        done.append(i)
        bound |= set(rule.body[i].variables())
    return done


def plan(rule: Rule, lookup: Lookup, first: int | None = None, sizes: dict[tuple[str, int], int] | None = None) -> DataFrame:
    """Rows of the rule's head, in the relation's columns; not yet distinct."""
    steps = order(rule, first, sizes)
    head = set(rule.head.variables())
    current: DataFrame | None = None
    for n, i in enumerate(steps):
        atom = rule.body[i]
        later = head | {v for j in steps[n + 1 :] for v in rule.body[j].variables()}
        right = scan(atom, lookup(i, atom))
        if current is None:
            current = right
        elif not atom.variables():
            current = current.crossJoin(right.drop("__exists"))  # at most one row: an existence guard
        else:
            have = {c[2:] for c in current.columns if c.startswith("v_")}
            shared = [v for v in atom.variables() if v in have]
            fresh = [v for v in atom.variables() if v not in have and v in later]
            on = [f"v_{v}" for v in shared]
            if not shared:
                current = current.crossJoin(right.select(*[f"v_{v}" for v in fresh]).distinct() if fresh else right.limit(1).select())
            elif not fresh:
                current = current.join(right.select(*on), on, "left_semi")
            else:
                used = right.select(*on, *[f"v_{v}" for v in fresh])
                current = current.join(used if len(used.columns) == len(right.columns) else used.distinct(), on)
        kept = [c for c in current.columns if c[2:] in later]
        if len(kept) < len(current.columns) and n < len(steps) - 1 and kept:
            current = current.select(*kept).distinct()
    value = [F.lit(t.value) if isinstance(t, Const) else F.col(f"v_{t.name}") for t in rule.head.args]
    return current.select(*[v.alias(c) for v, c in zip(value, COLUMNS[len(value)], strict=True)])
