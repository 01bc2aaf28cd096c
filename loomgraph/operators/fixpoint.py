"""Least fixpoint of a positive Datalog program over a triple store.

Predicates are evaluated by strata. A recursive stratum runs semi-naive rounds: every rule
is planned once for each recursive body atom with that atom reading the last round's new
rows; the union is made distinct, anti-joined with what is known, and written once to the
shared folder. Transitive closures of chain-like edges are evaluated by path doubling, so the
rounds grow with the logarithm of the longest path; facts of the closure's own predicate
that the store holds are joined to the result once.
"""

from __future__ import annotations

import time
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.terms import RDF_TYPE
from loomgraph.operators.store import ANY, COLUMNS, TripleStore
from loomgraph.plans.compiler import plan
from loomgraph.plans.ir import Atom, Program, Rule, Var
from loomgraph.session import cut, forget

Key = tuple[str, int]
Sizes = dict[Key, int]
#: A relation's pieces are merged when there are more, else its partitions grow with the rounds.
MOST_PIECES = 6
#: A closure that grows by more in a round isn't evaluated by doubling.
MOST_GROWTH = 2.5
#: Nodes with more neighbours aren't compared; classes of alike nodes that are broadcast have so many members at most.
MOST_NEIGHBOURS, MOST_MEMBERS = 16, 250_000


@dataclass
class Round:
    """new_rows: where alike nodes were taken together, those of one node of each class."""

    stratum: tuple[str, ...]
    number: int
    new_rows: int
    seconds: float


@dataclass
class Result:
    """relations: the derived predicates, base facts included; store: base and derived as one set of triples.

    fresh, after an extension: the triples that weren't known before it, the new facts among
    them. base_is_set: no triple of the base stands twice, so its relations need no shuffle.
    """

    base: TripleStore
    relations: dict[Key, DataFrame]
    rounds: list[Round] = field(default_factory=list)
    fresh: DataFrame | None = None
    base_is_set: bool = False

    def scan(self, key: Key) -> DataFrame:
        """The relation as rules read it: rows of the base may repeat."""
        if key in self.relations:
            return self.relations[key]
        every, classes = self.relations.get((ANY, 3)), self.relations.get((RDF_TYPE, 2))
        if every is not None:
            return TripleStore(every).relation(*key, distinct=False)
        if key[1] == 1 and classes is not None:
            return classes.filter(F.col("o") == key[0]).select("s")
        unary = [k for k in self.relations if k[1] == 1]
        if key == (RDF_TYPE, 2) and unary:
            return _union([self.base.relation(*key, distinct=False), *[self.relations[k].select("s", F.lit(k[0]).alias("o")) for k in unary]])
        return self.base.relation(*key, distinct=False)

    def relation(self, predicate: str, arity: int = 2) -> DataFrame:
        key = (predicate, arity)
        return self.scan(key) if key in self.relations or self.base_is_set else self.scan(key).distinct()

    @property
    def derived(self) -> DataFrame:
        return _union([as_triples(k, df) for k, df in self.relations.items()])

    @property
    def store(self) -> TripleStore:
        parts = [self.base.df, *([self.derived] if self.relations else [])]
        return TripleStore(_union(parts).distinct())


def as_triples(key: Key, df: DataFrame) -> DataFrame:
    if key[1] == 3:
        return df.select(COLUMNS)
    p, o = (F.lit(RDF_TYPE), F.lit(key[0])) if key[1] == 1 else (F.lit(key[0]), F.col("o"))
    return df.select("s", p.alias("p"), o.alias("o"))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def _closure(program: Program, group: list[Key]) -> tuple[str, str] | None:
    """(e, side) where the stratum is t :- e and t :- t, e (side "left"), or t :- e, t ("right"), and nothing else."""
    rules = [r for r in program.rules if r.head.key in group]
    if len(group) != 1 or group[0][1] != 2 or len(rules) != 2:
        return None
    t, (x, y, z) = group[0][0], (Var("x0"), Var("x1"), Var("x2"))
    base = [r for r in rules if len(r.body) == 1]
    step = [r for r in rules if len(r.body) == 2]
    if len(base) != 1 or len(step) != 1:
        return None
    e = base[0].body[0].predicate
    if e == t or base[0].canonical() != Rule(Atom(t, (x, y)), (Atom(e, (x, y)),)).canonical():
        return None
    for side, (a, b) in (("left", (t, e)), ("right", (e, t))):
        chain = Rule(Atom(t, (x, y)), (Atom(a, (x, z)), Atom(b, (z, y)))).canonical()
        if sorted(map(repr, step[0].canonical().body)) == sorted(map(repr, chain.body)):
            return e, side
    return None


def _steps(first: DataFrame, then: DataFrame) -> DataFrame:
    """(s, o) of a pair of first and the pair of then that it leads to."""
    return first.select("s", F.col("o").alias("m")).join(then.select(F.col("s").alias("m"), "o"), "m").select("s", "o")


def _close(out: Result, t: str, e: str, side: str, max_rounds: int) -> DataFrame:
    """t from the closure of e alone and, once, the store's own facts of t at the end that the rule leaves them.

    Round k joins the pairs that a walk of exactly 2^k edges links with all found, which
    doubles the longest walk. Where a round multiplies the pairs by more than
    MOST_GROWTH, as it can't along chains, walks branch: there are few rounds to
    save, and the rest goes on edge by edge.
    """
    began, key, names = time.time(), (t, 2), (t,)
    x, y, z = Var("x"), Var("y"), Var("z")
    exact = cut(out.scan((e, 2)).distinct())
    pieces, size, number = [exact], exact.count(), 0
    out.rounds.append(Round(names, 0, size, time.time() - began))
    while size:
        began, number = time.time(), number + 1
        if number > max_rounds:
            raise RuntimeError(f"no fixpoint after {max_rounds} rounds")
        whole = _union(pieces)
        new = unknown(_steps(exact, whole).distinct(), whole, size, size)
        n = new.count()
        out.rounds.append(Round(names, number, n, time.time() - began))
        if not n:
            break
        pieces, size = [*pieces, new], size + n
        if size > MOST_GROWTH * (size - n):
            full = {key: pieces}
            _rounds([Rule(Atom(t, (x, y)), (Atom(t, (x, z)), Atom(e, (z, y))))], [key], full, {key: new}, out.scan, max_rounds - number, out.rounds, began, start=number)
            pieces = full[key]
            break
        longer = cut(_steps(exact, exact).distinct())
        if number > 1:  # the first are the edges, which are pieces of the result
            forget(exact)
        exact = longer
    closed = _union(pieces)
    own = cut(out.base.relation(t))
    if own.isEmpty():
        return closed
    joined = _steps(own, closed) if side == "left" else _steps(closed, own)
    return cut(_union([closed, own, joined]).distinct())


def _free(rules: list[Rule], group: list[Key], e: Key, side: int) -> set[tuple[Key, int]] | None:
    """The positions that hold nodes from that side of e and never compare them; None if a rule would.

    A derived position is free if every rule fills it with a variable that stands once in
    the head and once in the body, there at a free position. Other variables at free
    positions must be bound by one that isn't free, or be used nowhere else.
    """
    free = {(k, i) for k in group for i in (0, 1)} | {(e, side)}
    uses = [Counter(v for a in r.body for v in a.variables()) for r in rules]
    places = [{v: [(a.key, i) for a in r.body for i, t in enumerate(a.args) if t == Var(v)] for v in u} for r, u in zip(rules, uses, strict=True)]

    def passed(r: Rule, at: dict, i: int) -> bool:
        t = r.head.args[i]
        return isinstance(t, Var) and r.head.args.count(t) == 1 and len(at[t.name]) == 1 and at[t.name][0] in free

    while lost := {(r.head.key, i) for r, at in zip(rules, places, strict=True) for i in (0, 1) if (r.head.key, i) in free and not passed(r, at, i)}:
        free -= lost
    for r, at in zip(rules, places, strict=True):
        for v, where in at.items():
            if all(x in free for x in where) and (len(where) > 1 or any(t == Var(v) and (r.head.key, i) not in free for i, t in enumerate(r.head.args))):
                return None
    return free if len(free) > 1 else None


def _alike(out: Result, rules: list[Rule], group: list[Key]) -> tuple[Key, DataFrame, DataFrame, set[tuple[Key, int]]] | None:
    """(e, e of one node of each class, (node, rep), free positions) where many nodes of a side of e have the same neighbours.

    Nodes that stand nowhere else in what the rules read, and are never compared, are
    interchangeable: a fact holds for one of a class if it holds for all.
    """
    atoms = [a for r in rules for a in (r.head, *r.body)]
    if any(len(a.args) != 2 or a.predicate == ANY for a in atoms):
        return None
    outside = sorted({a.key for a in atoms} - set(group))
    candidates = [(e, side, free) for e in outside for side in (0, 1) if (free := _free(rules, group, e, side))]
    if not candidates or any(not out.base.relation(*k, distinct=False).isEmpty() for k in group):
        return None
    named = [t.value for a in atoms for t in a.args if not isinstance(t, Var)]
    for e, side, free in candidates:
        edges = cut(out.scan(e).distinct())
        own, other = ("s", "o") if side == 0 else ("o", "s")
        solid = _union([edges.select(F.col(other).alias("node")), *[out.scan(k).select(F.col(c).alias("node")) for k in outside if k != e for c in ("s", "o")]])
        few = edges.groupBy(F.col(own).alias("node")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= MOST_NEIGHBOURS).select("node")
        few = few.filter(F.col("node").isNotNull() & ~F.col("node").isin(named)).join(solid, "node", "left_anti")
        around = edges.select(F.col(own).alias("node"), F.col(other).alias("x")).join(few, "node").groupBy("node").agg(F.sort_array(F.collect_set("x")).alias("all"))
        around = cut(around)
        members = cut(around.join(around.groupBy("all").agg(F.min("node").alias("rep")), "all").select("node", "rep"))
        n = members.agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("rep").alias("classes")).first()
        forget(around)
        if n.nodes and n.nodes >= 2 * n.classes:
            return e, cut(edges.join(members.filter("node <> rep").select(F.col("node").alias(own)), own, "left_anti")), members, free
        forget(edges, members)
    return None


def _expand(df: DataFrame, columns: list[str], members: DataFrame) -> DataFrame:
    """The rows of df, in which one node stands for each class, with all members in these columns."""
    small = members.count() <= MOST_MEMBERS
    for c in columns:
        named = members.select(F.col("rep").alias(c), "node")
        # what few rows become is made by all cores
        df = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism) if small else df
        df = df.join(F.broadcast(named) if small else named, c, "left").withColumn(c, F.coalesce("node", c)).drop("node")
    return df.select("s", "o")


def reason(base: TripleStore, program: Program, max_rounds: int = 10_000, new_facts: TripleStore | None = None, known: Result | None = None, statistics: bool = False) -> Result:
    """All consequences of the program.

    new_facts with known continues from an earlier result: only consequences that use a new
    fact are derived, and the result equals a full run over base and new facts. With
    statistics the facts of the program's predicates are counted first, in one pass, and
    atoms with fewer facts are joined earlier.
    """
    if known is not None and new_facts is not None:
        return _extend(base, program, max_rounds, new_facts, known)
    out = Result(base, {})
    relations = out.relations
    sizes = _sizes(base, program) if statistics else {}
    reads = Counter(a.key for r in program.rules for a in r.body)

    def find(_: int, atom: Atom) -> DataFrame:
        return out.scan(atom.key)

    for group in program.strata():
        if not program.recursive(group):
            for key in group:
                heads = [plan(r, find, sizes=sizes) for r in program.rules if r.head.key == key]
                whole = _union([base.relation(*key, distinct=False), *heads]).distinct()
                relations[key] = cut(whole) if reads[key] > 1 else whole
            continue
        if shape := _closure(program, group):
            relations[group[0]] = _close(out, group[0][0], *shape, max_rounds)
            continue
        rules = [r for r in program.rules if r.head.key in group]
        fixed = [r for r in rules if not any(a.key in group for a in r.body)]
        began = time.time()
        alike = _alike(out, rules, group)

        def read(key: Key, alike=alike) -> DataFrame:
            return alike[1] if alike and key == alike[0] else out.scan(key)

        full: dict[Key, list[DataFrame]] = {}
        for key in group:
            heads = [plan(r, lambda _, a, read=read: read(a.key), sizes=sizes) for r in fixed if r.head.key == key]
            full[key] = [cut(_union([base.relation(*key, distinct=False), *heads]).distinct())]
        _rounds(rules, group, full, {k: p[0] for k, p in full.items()}, read, max_rounds, out.rounds, began, sizes)
        relations |= {k: _union(p) for k, p in full.items()}
        if alike:
            relations |= {k: _expand(relations[k], [c for i, c in enumerate(("s", "o")) if (k, i) in alike[3]], alike[2]) for k in group}
    return out


def _sizes(base: TripleStore, program: Program) -> Sizes:
    """Facts of each binary predicate that the program names: one row for each."""
    named = sorted({a.predicate for r in program.rules for a in r.body if len(a.args) == 2})
    found = {r.p: r.n for r in base.predicate_counts(named).collect()}
    heads = program.heads()
    return {(p, 2): found.get(p, 0) for p in named if (p, 2) not in heads}


def _rounds(rules: list[Rule], group: list[Key], full: dict[Key, list[DataFrame]], delta: dict[Key, DataFrame], find, max_rounds: int, log: list[Round], began: float, sizes: Sizes | None = None, start: int = 0, grown: bool = True) -> None:
    """Runs semi-naive rounds until nothing is new.

    full holds each relation's pieces; new ones are appended, and the first, which may be
    large, is never copied. grown: the pieces are rows of this run, and are counted; else
    the first is taken to be large. start: rounds that were run before.
    """
    loops = [(r, i) for r in rules for i, a in enumerate(r.body) if a.key in group]
    # relations from outside the stratum are read in every round
    outside = {k: cut(find(k)) for k in {a.key for r, _ in loops for a in r.body if a.key not in group}}
    names = tuple(k[0] for k in group)
    counts = {k: d.count() for k, d in delta.items()}
    totals = {k: sum(d.count() for d in p) if grown else None for k, p in full.items()}
    if not start:
        log.append(Round(names, 0, sum(counts.values()), time.time() - began))
    for number in range(1, max_rounds + 1):
        began = time.time()
        whole = {k: _union(p) for k, p in full.items()}
        fresh: dict[Key, DataFrame] = {}
        for key in group:
            plans = []
            for r, at in loops:
                if r.head.key == key and r.body[at].key in delta:
                    def look(i: int, a: Atom, at: int = at) -> DataFrame:
                        return delta[a.key] if i == at else whole[a.key] if a.key in whole else outside[a.key]

                    plans.append(plan(r, look, first=at, sizes=sizes))
            if plans:
                fresh[key] = unknown(_union(plans).distinct(), whole[key], totals[key], sum(counts.values()))
        counts = {k: df.count() for k, df in fresh.items()}
        log.append(Round(names, start + number, sum(counts.values()), time.time() - began))
        delta = {k: df for k, df in fresh.items() if counts[k]}
        for k, df in delta.items():
            full[k].append(df)
            totals[k] = None if totals[k] is None else totals[k] + counts[k]
            if len(full[k]) > MOST_PIECES:
                old = full[k][1:]
                full[k][1:] = [cut(_union(old))]
                forget(*[p for p in old if p is not df])  # the next round reads df
        if not delta:
            return
    raise RuntimeError(f"no fixpoint after {max_rounds} rounds")


def unknown(new: DataFrame, known: DataFrame, size: int | None, expected: int = 0) -> DataFrame:
    """Materialised: the rows of new that aren't among the known, of which there are size (None: many); expected: about how many new ones.

    Where new is far smaller, it is written first and joins are built from it: the known are
    read, but not shuffled.
    """
    if size is not None and size <= 8 * expected:
        return cut(new.join(known, new.columns, "left_anti"))
    new = cut(new)
    out = cut(new.join(known.join(new, new.columns, "left_semi"), new.columns, "left_anti"))
    forget(new)
    return out


def _extend(base: TripleStore, program: Program, max_rounds: int, new_facts: TripleStore, known: Result) -> Result:
    """Seeds every rule with the new facts at each body atom, then runs one joint semi-naive loop."""
    both = base.add(new_facts)
    keys = sorted({a.key for r in program.rules for a in (r.head, *r.body)})
    out = Result(both, {})
    full: dict[Key, list[DataFrame]] = {}
    delta: dict[Key, DataFrame] = {}
    began = time.time()
    for key in keys:
        old = known.relation(*key)
        delta[key] = unknown(new_facts.relation(*key), old, None)
        full[key] = [old, delta[key]]
    _rounds(program.rules, keys, full, delta, None, max_rounds, out.rounds, began, grown=False)
    out.relations.update({k: _union(full[k]) for k in program.heads()})
    facts = unknown(new_facts.df.distinct(), known.store.df if known.relations else known.base.df, None)
    out.fresh = _union([facts, *[as_triples(k, _union(full[k][1:])) for k in keys]]).distinct()
    return out
