import os
import random
import sqlite3
import subprocess
import sys

import duckdb
import pytest

from loomgraph import TripleStore, parse_program, read_program, reason
from loomgraph.functions.terms import RDF_TYPE
from loomgraph.operators.dictionary import TermDictionary
from loomgraph.plans.catalog import ORACLES, QUERIES
from loomgraph.plans.ir import DatalogError
from loomgraph.sources import text
from loomgraph.sources.tables import from_table, read_sqlite

SF = "/root/testdata/sf0.001"


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def got(df):
    return sorted(map(tuple, df.collect()))


def test_ntriples(spark):
    df = text.ntriples(lines(spark, "<a> <b> <c> .", "<a> <b> _:x .", '<a> <b> "" .', '<a> <b> "x"@en .', "_:x <b> <c> .", "<a> <b>", "# note", '<a> "b" <c> .'))
    assert got(df) == sorted([("a", "b", "c"), ("a", "b", "_:x"), ("a", "b", '""'), ("a", "b", '"x"@en'), ("_:x", "b", "c")])


def test_turtle(spark):
    df = text.turtle(lines(spark, "@prefix ex: <http://e/> .", "ex:a ex:p ex:b.", 'ex:a ex:p "x:y" .', "_:b1 ex:p _:b2 .", "ex:a a ex:T .", "no:a ex:p ex:b .", "# c", "ex:a ex:p ex:b ;", '<http://e/x> ex:p "5"^^xsd:int .'))
    assert got(df) == sorted([("http://e/a", "http://e/p", "http://e/b"), ("http://e/a", "http://e/p", '"x:y"'), ("_:b1", "http://e/p", "_:b2"), ("http://e/a", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", "http://e/T"), ("no:a", "http://e/p", "http://e/b"), ("http://e/x", "http://e/p", '"5"^^xsd:int')])


def test_csv_and_failfast(spark):
    rows = lines(spark, "a,b,c,d", "a,,c", "a,b", "a,b,", "x,y, z")
    assert got(text.csv(rows)) == [("a", "", "c"), ("a", "b", "c"), ("x", "y", " z")]
    assert text.rejected(rows, "csv").count() == 2
    with pytest.raises(Exception, match="not a triple"):
        text.csv(rows, mode="failfast").collect()


def test_tables(spark, tmp_path):
    t = spark.createDataFrame([("a", None, "c"), ("a", "b", "c")], "subject string, predicate string, object string")
    assert got(from_table(t)) == [("a", "", "c"), ("a", "b", "c")]
    assert got(from_table(t, "drop")) == [("a", "b", "c")]
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t(subject, predicate, object)")
        db.executemany("INSERT INTO t VALUES (?, ?, ?)", [(f"s{i}", "p", "o" if i else None) for i in range(25)])
    assert read_sqlite(spark, path, "t", rows=10).count() == 24


def test_store_and_dictionary(spark, tmp_path):
    s = TripleStore.of(spark, [("a", "p", "b"), ("a", "p", "b"), ("b", "q", "a"), (None, "p", "x")])
    assert (s.count(), s.count(distinct=True)) == (3, 2)
    assert s.contains("b", "q", "a") and not s.contains("b", "q", "b")
    assert s.by_subject("zz").count() == 0
    assert got(s.remove(s.by_predicate("q")).df) == [("a", "p", "b")] * 2
    s.write(str(tmp_path / "store"))
    assert TripleStore.read(spark, str(tmp_path / "store")).by_predicate("p").count() == 2
    d = TermDictionary.build(s.df)
    assert [tuple(r) for r in d.df.orderBy("id").collect()] == [("a", 0), ("b", 1), ("p", 2), ("q", 3)]
    assert got(d.decode(d.encode(s.df))) == got(s.df)


@pytest.mark.parametrize("rule", ["h(?x, ?z) :- p(?x, ?y).", "a(x, y).", "h(?x) :- p(?x, ?y), NOT q(?x).", "h(?x) :- p(?x, ?y), ?x != ?y.", "h(?x) :- p(?x, ?y, ?z).", "h(?x) :- p(?x, ?y)"])
def test_bad_rules_raise(rule):
    with pytest.raises(DatalogError):
        parse_program(rule)


def test_rule_text():
    p = parse_program("# c\nPREFIX ex: <http://e/>\nex:h(?X,?Y):-ex:p(?X , ex:c),  q(?X,?Y).\n")
    assert p.rules[0].head.predicate == "http://e/h" and p.rules[0].body[0].args[1].value == "http://e/c"
    q = parse_program("h(?x) :- p(?x, ?y).\nbroken\nh(?x) :- q(?x).", strict=False)
    assert len(q.rules) == 2 and q.skipped


def test_symmetric_closure_of_a_chain(spark):
    """Copy, symmetry and transitivity over a chain of islands and ferries: all pairs, each with itself too."""
    ferries = [(f"isle{k}", "ferry", f"isle{k + 1}") for k in range(4)]
    r = reason(TripleStore.of(spark, ferries), parse_program("linked(?a, ?b) :- ferry(?a, ?b).\nlinked(?a, ?b) :- linked(?b, ?a).\nlinked(?a, ?c) :- linked(?a, ?b), linked(?b, ?c)."))
    assert r.relation("linked").count() == 25
    assert r.store.count() == 29


@pytest.mark.parametrize(
    ("facts", "rules", "head", "want"),
    [
        ([("a", "p", "b"), ("c", "q", "d")], "h(?x, ?y) :- p(?x, ?y), q(?x, ?y).", ("h", 2), []),
        ([("a", "p", "b")], "h(?x, ?y) :- p(?x, ?y), none(?y, ?z).", ("h", 2), []),
        ([("a", "p", "b"), ("b", "p", "a"), ("c", "p", "c")], "h(?x) :- p(?x, ?x).", ("h", 1), [("c",)]),
        ([("a", "p", "b")], "h(?x) :- p(?x, ?y), p(zz, zz).", ("h", 1), []),
        ([("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a")], "h(?x) :- p(?x, ?y), p(?y, ?z), p(?z, ?x).", ("h", 1), [("a",), ("b",), ("c",)]),
        ([("a", "p", "b")], "k(?x) :- p(?x, ?y).\nh(?x) :- k(?x).", ("h", 1), [("a",)]),
    ],
)
def test_rule_shapes(spark, facts, rules, head, want):
    assert got(reason(TripleStore.of(spark, facts), parse_program(rules)).relation(*head)) == want


def naive(facts, rules):
    """Least fixpoint over Python sets; rules as (head, [(pred, x, y)])."""
    known = set(facts)
    while True:
        new = set()
        for (hp, hx, hy), body in rules:
            envs = [{}]
            for p, x, y in body:
                envs = [e | {x: s, y: o} for e in envs for s, q, o in known if q == p and e.get(x, s) == s and e.get(y, o) == o and (x != y or s == o)]
            new |= {(e[hx], hp, e[hy]) for e in envs}
        if new <= known:
            return known
        known |= new


def test_random_graphs(spark):
    pool = [(("t", "x", "y"), [("e", "x", "y")]), (("t", "x", "z"), [("t", "x", "y"), ("e", "y", "z")]), (("u", "x", "y"), [("t", "y", "x"), ("f", "x", "y")]), (("e", "x", "y"), [("u", "x", "y")])]
    rng = random.Random(7)
    for _ in range(2):
        facts = {(f"n{rng.randrange(6)}", rng.choice("ef"), f"n{rng.randrange(6)}") for _ in range(9)}
        out = reason(TripleStore.of(spark, sorted(facts)), parse_program(as_text(pool)))
        assert set(got(out.store.df)) == naive(facts, pool)


def as_text(rules):
    return "\n".join(f"{h[0]}(?{h[1]}, ?{h[2]}) :- {', '.join(f'{p}(?{x}, ?{y})' for p, x, y in b)}." for h, b in rules)


LINEAR = {"left": [("t", "x", "y"), ("e", "y", "z")], "right": [("e", "x", "y"), ("t", "y", "z")]}


@pytest.mark.parametrize("side", ["left", "right"])
@pytest.mark.parametrize("shape", ["random", "chain", "cycle"])
def test_closures_with_facts_of_their_own(spark, side, shape):
    """Facts of the head predicate, in the store or new: paths through them go on one way only."""
    rng = random.Random(f"{side}{shape}")
    edges = {"random": {(f"n{rng.randrange(9)}", "e", f"n{rng.randrange(9)}") for _ in range(22)}, "chain": {(f"n{k}", "e", f"n{k + 1}") for k in range(20)}, "cycle": {(f"n{k}", "e", f"n{(k + 1) % 7}") for k in range(7)}}[shape]
    own = {(f"n{rng.randrange(12)}", "t", f"n{rng.randrange(12)}") for _ in range(5)}
    rules = [(("t", "x", "y"), [("e", "x", "y")]), (("t", "x", "z"), LINEAR[side])]
    program = parse_program(as_text(rules))
    assert set(got(reason(TripleStore.of(spark, sorted(edges | own)), program).store.df)) == naive(edges | own, rules)
    base = TripleStore.of(spark, sorted(edges))
    more = reason(base, program, new_facts=TripleStore.of(spark, sorted(own)), known=reason(base, program))
    assert set(got(more.store.df)) == naive(edges | own, rules)
    assert set(got(more.fresh)) == naive(edges | own, rules) - naive(edges, rules)


def test_extension_reads_a_closed_set_without_a_shuffle(spark):
    from loomgraph.operators.fixpoint import Result

    s = TripleStore.of(spark, [("a", "t", "b")])
    plan = lambda r: r.relation("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan(Result(s, {})) and "Aggregate" not in plan(Result(s, {}, base_is_set=True))


def test_unsound_doubling_is_gone(spark):
    s = TripleStore.of(spark, [("a", "t", "b"), ("b", "t", "c"), ("x", "e", "y")])
    r = reason(s, parse_program("t(?x, ?y) :- e(?x, ?y).\nt(?x, ?z) :- t(?x, ?y), e(?y, ?z)."))
    assert got(r.relation("t")) == [("a", "b"), ("b", "c"), ("x", "y")]


def test_random_programs_with_facts_of_heads(spark):
    pool = [(("t", "x", "y"), [("e", "x", "y")]), (("t", "x", "z"), [("t", "x", "y"), ("t", "y", "z")]), (("u", "x", "z"), [("t", "x", "y"), ("f", "y", "z")]), (("w", "x", "y"), [("u", "y", "x"), ("t", "x", "x")])]
    rng = random.Random(11)
    facts = {(f"n{rng.randrange(6)}", rng.choice("eftuw"), f"n{rng.randrange(6)}") for _ in range(16)}
    out = reason(TripleStore.of(spark, sorted(facts)), parse_program(as_text(pool)), statistics=True)
    assert set(got(out.store.df)) == naive(facts, pool)
    again = reason(out.store, parse_program(as_text(pool)))
    assert set(got(again.store.df)) == naive(facts, pool)


FAMILY = [
    (("mother", "x", "y"), [("bore", "x", "y")]),
    (("grand", "x", "z"), [("bore", "x", "y"), ("bore", "y", "z")]),
    (("great", "x", "w"), [("grand", "x", "z"), ("bore", "z", "w")]),
    (("kin", "y", "z"), [("bore", "x", "y"), ("bore", "x", "z")]),
    (("pal", "x", "y"), [("met", "x", "y")]),
    (("pal", "x", "y"), [("met", "y", "x")]),
    (("worksIn", "x", "z"), [("job", "x", "y"), ("at", "y", "z")]),
]
LOCAL = "home(?x) :- lives(?x, ?c), worksIn(?x, ?c)."


def village(persons, meetings):
    rng = random.Random(persons)
    facts = {(f"p{(k * 5) % (k // 2 + 1)}", "bore", f"p{k}") for k in range(1, persons) if k % 3}
    facts |= {(f"p{rng.randrange(persons)}", "met", f"p{rng.randrange(persons)}") for _ in range(meetings)}
    facts |= {(f"firm{k}", "at", f"town{k % 3}") for k in range(5)}
    return facts | {(f"p{k}", p, f"{w}{rng.randrange(5 if w == 'firm' else 3)}") for k in range(persons) for p, w in (("job", "firm"), ("lives", "town"))}


@pytest.mark.parametrize(("persons", "meetings"), [(12, 16), (300, 500)])
def test_eight_rules(spark, persons, meetings):
    """Copy, joins of two, a chain over a derived predicate, a self-join, a union with an inverse, and a unary head, against sets."""
    facts = village(persons, meetings)
    want = naive(facts, FAMILY)
    home = {x for x, p, c in want if p == "lives" and (x, "worksIn", c) in want}
    out = reason(TripleStore.of(spark, sorted(facts)), parse_program(as_text(FAMILY) + "\n" + LOCAL))
    assert set(got(out.store.df)) == want | {(x, RDF_TYPE, "home") for x in home}
    assert got(out.relation("home", 1)) == sorted((x,) for x in home)


def test_classes_are_one_relation(spark):
    s = TripleStore.of(spark, [("a", "p", "b"), ("z", RDF_TYPE, "C")])
    prefix = "PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>\n"
    r = reason(s, parse_program(prefix + "C(?x) :- p(?x, ?y).\nh(?x) :- rdf:type(?x, C).\nrdf:type(?x, D) :- h(?x).\nk(?x) :- D(?x)."))
    assert [got(r.relation(c, 1)) for c in "ChDk"] == [[("a",), ("z",)]] * 4
    assert got(r.relation(RDF_TYPE)) == sorted((x, c) for x in "az" for c in "ChDk")
    v = reason(s, parse_program(prefix + "C(?x) :- p(?x, ?y).\nof(?c, ?x) :- rdf:type(?x, ?c).\nE(?x) :- of(C, ?x)."))
    assert got(v.relation("of")) == [("C", "a"), ("C", "z"), ("E", "a"), ("E", "z")]
    assert got(v.relation("E", 1)) == [("a",), ("z",)]


def test_predicate_variables(spark):
    s = TripleStore.of(spark, [("p", "sub", "q"), ("q", "sub", "r"), ("a", "p", "b"), ("c", "q", "d")])
    r = reason(s, parse_program("?q(?x, ?y) :- sub(?p, ?q), ?p(?x, ?y).\nused(?p) :- ?p(?x, ?y)."))
    assert got(r.relation("r")) == [("a", "b"), ("c", "d")]
    assert got(r.relation("q")) == [("a", "b"), ("c", "d")]
    assert got(r.relation("used", 1)) == [(p,) for p in (RDF_TYPE, "p", "q", "r", "sub")]
    with pytest.raises(DatalogError):
        parse_program("h(?x) :- ?p(?x, ?y, ?z).")


def test_rounds(spark):
    chain = TripleStore.of(spark, [(f"n{k:02d}", "e", f"n{k + 1:02d}") for k in range(32)])
    program = parse_program("t(?x, ?y) :- e(?x, ?y).\nt(?x, ?z) :- t(?x, ?y), e(?y, ?z).")
    r = reason(chain, program)
    assert [x.new_rows for x in r.rounds] == [32, 31, 30 + 29, sum(range(25, 29)), sum(range(17, 25)), sum(range(1, 17)), 0]
    with pytest.raises(RuntimeError, match="no fixpoint after 3 rounds"):
        reason(chain, program, max_rounds=3)


def test_order_by_statistics():
    from loomgraph.plans.compiler import order

    rule = parse_program("h(?x, ?z) :- p(?x, ?y), q(?y, ?z), r(?z, ?w).").rules[0]
    assert order(rule, None, {("p", 2): 1000, ("q", 2): 10, ("r", 2): 5}) == [2, 1, 0]
    assert order(rule, None) == [0, 1, 2]


def test_scans_of_relations_need_no_shuffle(spark):
    """A path of two over the store: the join and the final distinct are all that shuffles."""
    s = TripleStore.of(spark, [("a", "p", "b")])
    plan = reason(s, parse_program("h(?x, ?z) :- p(?x, ?y), q(?y, ?z).")).relation("h")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 1


def test_files(spark, tmp_path):
    """Three triples in each format, the last line without a newline."""
    rows = [(f"http://h.example/s{k}", "http://h.example/p", f'"o{k}"') for k in range(3)]
    (tmp_path / "a.nt").write_text("\n".join(f"<{s}> <{p}> {o} ." for s, p, o in rows))
    (tmp_path / "a.ttl").write_text("@prefix h: <http://h.example/> .\n" + "\n".join(f"h:s{k} h:p {o} ." for k, (_, _, o) in enumerate(rows)))
    (tmp_path / "b.ttl").write_text("h:s0 h:p h:s1 .\n@prefix h: <http://b/> .\nh:s0 h:p h:s1 .\n@prefix h: <http://c/> .")
    (tmp_path / "a.csv").write_text("\n".join(",".join(r) for r in rows))
    for read, name in ((text.read_ntriples, "a.nt"), (text.read_turtle, "a.ttl"), (text.read_csv, "a.csv")):
        assert got(read(spark, str(tmp_path / name))) == rows
    both = text.read_turtle(spark, str(tmp_path / "*.ttl"))
    assert got(both) == sorted(rows + [("http://c/s0", "http://c/p", "http://c/s1")] * 2)
    text.write_ntriples(both, str(tmp_path / "out"))
    assert got(text.read_ntriples(spark, str(tmp_path / "out"))) == got(both)
    (tmp_path / "r.dl").write_text("# one rule\nPREFIX h: <http://h.example/>\n\nh:q(?x, ?y) :- h:p(?y, ?x).")
    assert reason(TripleStore(both), read_program(str(tmp_path / "r.dl"))).relation("http://h.example/q").count() == 3


def test_turtle_documents(spark, tmp_path):
    from loomgraph.sources.turtle import TurtleError, parse, read_turtle_documents

    x, integer = "http://www.w3.org/2001/XMLSchema#", "integer"
    (tmp_path / "a.ttl").write_text("""@prefix e: <http://e/> . @base <http://b/c/> .
# one subject, many properties
e:a a e:T ; e:p "x"@en, 'y', 5 , -1.5, 1e3, true ;
   e:q [ e:r e:s ; e:t \"\"\"long "q"
line\"\"\" ] .
<rel> e:list ( e:a "b" ) . [] e:p _:k .""")
    (tmp_path / "b.ttl").write_text("PREFIX e: <http://f/>\ne:a e:p _:k .")
    rows = read_turtle_documents(spark, str(tmp_path / "*.ttl")).collect()
    own = {(r.p, r.o) for r in rows if r.s == "http://e/a"}
    inner = next(o for p, o in own if p == "http://e/q")
    assert own == {(RDF_TYPE, "http://e/T"), ("http://e/q", inner), *[("http://e/p", o) for o in ('"x"@en', '"y"', f'"5"^^<{x}{integer}>', f'"-1.5"^^<{x}decimal>', f'"1e3"^^<{x}double>', f'"true"^^<{x}boolean>')]}
    assert {(r.p, r.o) for r in rows if r.s == inner} == {("http://e/r", "http://e/s"), ("http://e/t", '"long \\"q\\"\\nline"')}
    head = next(r.o for r in rows if r.s == "http://b/c/rel")
    assert sorted(r.o for r in rows if r.s == head and r.p.endswith("first")) == ["http://e/a"]
    assert len({r.o for r in rows if r.o.endswith("k")}) == 2  # a blank node's name holds in its file
    for bad in ("e:a e:b e:c .", "<a> <b> .", "<a> <b> <c>", "<a> <b> ( <c> .", "<a> <b> <c> ."[:-2] + " <d> ."):
        with pytest.raises(TurtleError, match="line 1"):
            parse(bad)


def test_store_on_disk(spark, tmp_path):
    rows = [("a", "", "c"), ("a", "p/ x=1", "c"), ("b", "long" * 100, "d"), ("b", "long" * 100 + "er", "d"), ("a", "__HIVE_DEFAULT_PARTITION__", "z")]
    TripleStore.of(spark, rows).write(str(tmp_path / "s"))
    back = TripleStore.read(spark, str(tmp_path / "s"))
    assert got(back.df) == sorted(rows)
    for s, p, o in rows:
        assert got(back.by_predicate(p)) == [(s, p, o)] and back.contains(s, p, o) and got(back.relation(p)) == [(s, o)]
    plan = back.by_predicate("p/ x=1")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(folder" in plan


def test_positions(spark):
    s = TripleStore.of(spark, [(f"n{k % 17:02d}", "p", f"m{k}") for k in range(60)])
    ordered = got(s.df)
    assert [tuple(r) for r in s.numbered().orderBy("row_id").collect()] == [(k, *t) for k, t in enumerate(ordered)]
    assert tuple(s.at(59)) == ordered[59]
    assert got(s.fetch(spark.createDataFrame([(3,), (3,), (1000,)], "k long"))) == [(3, *ordered[3])]
    with pytest.raises(IndexError):
        s.at(60)


def test_dictionary_lookups(spark, monkeypatch):
    s = TripleStore.of(spark, [("a", "p", "b"), ("b", "p", "c")])
    d = TermDictionary.build(s.df)
    probe = spark.createDataFrame([("a",), ("zz",), ("p",)], "term string")
    assert got(d.contains(probe)) == [("a",), ("p",)] and d.size() == 4
    assert sorted(map(tuple, d.lookup(probe).collect()), key=repr) == [("a", 0), ("p", 3), ("zz", None)]
    unknown = spark.createDataFrame([(0, 3, 99)], "s long, p long, o long")
    assert got(d.decode(unknown)) == [("a", "p", "")]
    monkeypatch.setattr("loomgraph.operators.dictionary.BROADCAST_BYTES", 0)  # the salted way
    assert got(d.decode(d.encode(s.df))) == got(s.df)


def test_no_local_folder_on_a_cluster(monkeypatch):
    from types import SimpleNamespace

    from loomgraph.session import shared_dir

    unset = SimpleNamespace(isDefined=lambda: False)
    context = SimpleNamespace(master="spark://host:7077", _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: unset)))
    fake = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda k, d: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_dir(fake)


@pytest.mark.parametrize("name", ["rule_type_unary", "rule_subproperties", "fetch_by_position", "jdbc_by_ranges", "jdbc_by_predicates", "turtle_two_files", "store_write_read", "closure_with_new_head_facts", "reason_statistics", "sqlite_table", "scan_geo", "dictionary_stats", "located_in_closure", "even_path", "rule_cycle_cust_supp", "incremental_equals_full"])
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "orders", "lineitem", "events", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    assert got(df.select(*cols)) == sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall())


SG = "sg(?x, ?y) :- up(?x, ?z), up(?y, ?z).\nsg(?x, ?y) :- up(?x, ?a), sg(?a, ?b), up(?y, ?b)."


@pytest.mark.parametrize("rules, head, together", [
    (SG, "sg", True),
    ("p(?x, ?y) :- up(?x, ?y).\np(?x, ?z) :- p(?x, ?y), up(?y, ?z).\np(?x, ?y) :- other(?x, ?y).", "p", False),
    ("p(?x, ?y) :- up(?x, ?z), up(?y, ?z).\np(?x, ?y) :- p(?x, ?a), p(?a, ?y).", "p", False),
    ("p(?x, ?x) :- up(?x, ?z).\np(?x, ?y) :- p(?x, ?a), up(?y, ?a).", "p", False),
    (SG + "\nsg(?x, ?y) :- up(leaf3, ?a), sg(?a, ?b), up(?x, ?b), up(?y, ?b).", "sg", True),
    ("sg(?x, leaf2) :- up(?x, ?z).\nsg(?x, ?y) :- up(?x, ?a), sg(?a, ?y).", "sg", True),
    ("c(?x, ?y) :- up(?z, ?x), up(?z, ?y).\nc(?x, ?y) :- c(?a, ?b), up(?a, ?x), up(?b, ?y).", "c", False),
])
def test_alike_nodes_are_taken_together(spark, monkeypatch, rules, head, together):
    """The relation that all nodes one by one give, from one node of each class where rules don't compare nodes."""
    from loomgraph.operators import fixpoint

    rng = random.Random(4)
    up = {(f"leaf{i}", f"mid{rng.randrange(3)}") for i in range(30)} | {("leaf1", "mid0"), ("leaf1", "mid1"), ("leaf2", "leaf5"), ("leaf6", "leaf6")} | {(f"mid{i}", f"top{i % 2}") for i in range(3)}
    other = {("leaf7", "mid1"), ("top0", "leaf8")} if "other" in rules else set()
    store = TripleStore(spark.createDataFrame([(s, "up", o) for s, o in sorted(up)] + [(s, "other", o) for s, o in sorted(other)], "s string, p string, o string"))
    found, seen = fixpoint._alike, []
    monkeypatch.setattr(fixpoint, "_alike", lambda *a: seen.append(found(*a)) or seen[-1])
    have = got(reason(store, parse_program(rules)).relation(head))
    monkeypatch.setattr(fixpoint, "_alike", lambda *a: None)
    assert have == got(reason(store, parse_program(rules)).relation(head))
    assert bool(seen and seen[0]) == together


def test_database_is_read_by_other_processes(spark):
    """Executors are processes of their own: what one of them reads is what the driver loaded."""
    from loomgraph.plans.catalog import _database

    url, properties = _database(spark, SF, "shared")
    assert spark.read.jdbc(url, "facts", properties=properties).count() == spark.read.parquet(f"{SF}/customer.parquet").count()
    code = f"""from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
print("rows", s.read.jdbc({url!r}, "facts", properties={properties!r}).filter("object IS NULL").count())"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, env={k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK_GATEWAY", "SPARK_"))})
    assert f"rows {spark.read.parquet(f'{SF}/customer.parquet').filter('c_custkey % 5 = 0').count()}" in out.stdout, out.stderr[-2000:]


def test_stream(spark, tmp_path):
    from loomgraph.streaming.incremental import latest, maintain

    source = str(tmp_path / "in")
    program = parse_program("t(?x, ?y) :- e(?x, ?y).\nt(?x, ?z) :- t(?x, ?y), t(?y, ?z).")
    for rows in ([("a", "e", "b")], [("b", "e", "c")]):
        spark.createDataFrame(rows, "s string, p string, o string").write.mode("append").parquet(source)
        stream = spark.readStream.schema("s string, p string, o string").parquet(source)
        maintain(stream, program, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert latest(spark, str(tmp_path / "out")).by_predicate("t").count() == 3
    assert spark.read.parquet(str(tmp_path / "out" / "v=000000001")).count() == 3  # only what the second batch added
