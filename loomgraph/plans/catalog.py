"""Queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

import os
import shutil
import sqlite3
import zipfile
from collections.abc import Callable
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import dictionary
from loomgraph.operators.dictionary import TermDictionary
from loomgraph.operators.fixpoint import reason
from loomgraph.operators.store import TripleStore
from loomgraph.plans.ir import Atom, Program, Rule, Var
from loomgraph.plans.parser import parse_program, read_program
from loomgraph.session import discard, scratch
from loomgraph.sources import tables, text, triplify
from loomgraph.sources.turtle import documents

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

GEO = """geo AS (
  SELECT 'customer/' || c_custkey AS s, 'inNation' AS p, 'nation/' || c_nationkey AS o FROM customer
  UNION ALL SELECT 'supplier/' || s_suppkey, 'inNation', 'nation/' || s_nationkey FROM supplier
  UNION ALL SELECT 'nation/' || n_nationkey, 'inRegion', 'region/' || n_regionkey FROM nation
  UNION ALL SELECT 'nation/' || n_nationkey, 'name', '"' || n_name || '"' FROM nation
  UNION ALL SELECT 'region/' || r_regionkey, 'name', '"' || r_name || '"' FROM region)"""
NEXT = """nxt AS (
  SELECT 'conv/' || a.conv_id || '/' || a.turn AS s, 'conv/' || b.conv_id || '/' || b.turn AS o
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
FOLLOWS = """fol AS (
  SELECT DISTINCT 'type/' || before AS s, 'type/' || event_type AS o FROM (
    SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
  WHERE before IS NOT NULL)"""
ORDERS = """sold AS (SELECT DISTINCT l_orderkey AS k, l_suppkey AS sk FROM lineitem),
placed AS (SELECT o_orderkey AS k, o_custkey AS ck FROM orders)"""


def query(sql: str):
    """Registers a function of (spark, sf_dir) under its name with its SQL."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return put


def derived(triples: DataFrame, rules: str, head: str, arity: int = 2) -> DataFrame:
    return reason(TripleStore(triples), parse_program(rules)).relation(head, arity)


@query(f"WITH {GEO} SELECT s, p, o FROM geo")
def scan_geo(spark, sf_dir):
    return TripleStore(triplify.geo(spark, sf_dir)).df


@query(f"WITH {GEO} SELECT s, p, o FROM geo WHERE s = 'nation/5'")
def by_subject(spark, sf_dir):
    return TripleStore(triplify.geo(spark, sf_dir)).by_subject("nation/5")


@query(f"WITH {GEO} SELECT s, p, o FROM geo WHERE p = 'inRegion'")
def by_predicate(spark, sf_dir):
    return TripleStore(triplify.geo(spark, sf_dir)).by_predicate("inRegion")


@query(f"WITH {GEO} SELECT s, p, o FROM geo WHERE o = 'region/2'")
def by_object(spark, sf_dir):
    return TripleStore(triplify.geo(spark, sf_dir)).by_object("region/2")


@query(f"""WITH {GEO}, probe AS (
  SELECT 'customer/' || c_custkey AS s, 'inNation' AS p, 'nation/' || (c_custkey % 25) AS o FROM customer)
SELECT s, p, o FROM probe SEMI JOIN geo USING (s, p, o)""")
def contains_triples(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    probe = c.select(triplify.node("customer", "c_custkey").alias("s"), F.lit("inNation").alias("p"), F.concat(F.lit("nation/"), (F.col("c_custkey") % 25).cast("string")).alias("o"))
    return TripleStore(triplify.geo(spark, sf_dir)).contains_all(probe)


@query(f"""WITH {GEO}, twice AS (SELECT * FROM geo UNION ALL SELECT * FROM geo)
SELECT (SELECT count(*) FROM twice)::BIGINT AS n_bag, (SELECT count(*) FROM (SELECT DISTINCT * FROM twice))::BIGINT AS n_set""")
def count_bag_and_set(spark, sf_dir):
    one = TripleStore(triplify.geo(spark, sf_dir))
    per = one.add(one).df.groupBy("s", "p", "o").agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_bag"), F.count(F.lit(1)).alias("n_set"))


@query(f"WITH {GEO} SELECT p, count(*)::BIGINT AS n FROM geo GROUP BY p")
def predicate_stats(spark, sf_dir):
    return TripleStore(triplify.geo(spark, sf_dir)).predicate_counts()


@query(f"""WITH {GEO}, terms AS (SELECT s AS t FROM geo UNION ALL SELECT p FROM geo UNION ALL SELECT o FROM geo),
d AS (SELECT t, count(*) AS n FROM terms GROUP BY t)
SELECT count(*)::BIGINT AS unique_terms, sum(strlen(t))::BIGINT AS total_bytes, sum(strlen(t) * n)::BIGINT AS occurrence_bytes,
  sum(strlen(t) * n)::DOUBLE / sum(strlen(t))::DOUBLE AS compression_ratio FROM d""")
def dictionary_stats(spark, sf_dir):
    return dictionary.stats(TripleStore(triplify.geo(spark, sf_dir)).df)


@query(f"WITH {GEO} SELECT s, p, o FROM geo")
def dictionary_roundtrip(spark, sf_dir):
    triples = TripleStore(triplify.geo(spark, sf_dir)).df
    terms = TermDictionary.build(triples)
    return terms.decode(terms.encode(triples))


@query(f"""WITH {GEO}, terms AS (SELECT s AS t FROM geo UNION SELECT p FROM geo UNION SELECT o FROM geo)
SELECT t AS term, (row_number() OVER (ORDER BY t) - 1)::BIGINT AS id FROM terms""")
def dictionary_ids(spark, sf_dir):
    return TermDictionary.build(TripleStore(triplify.geo(spark, sf_dir)).df).df


@query(f"""WITH {GEO} SELECT 'http://example.org/' || s AS s, 'http://example.org/' || p AS p,
  CASE WHEN o LIKE '"%' THEN o ELSE 'http://example.org/' || o END AS o FROM geo""")
def ntriples_parse(spark, sf_dir):
    iri = lambda c: F.concat(F.lit("<http://example.org/"), F.col(c), F.lit(">"))
    o = F.when(F.col("o").startswith('"'), F.col("o")).otherwise(iri("o"))
    return text.ntriples(triplify.geo(spark, sf_dir).select(F.concat_ws(" ", iri("s"), iri("p"), o, F.lit(".")).alias("value")))


@query(ORACLES["ntriples_parse"])
def turtle_parse(spark, sf_dir):
    name = lambda c: F.concat(F.lit("ex:"), F.col(c))
    o = F.when(F.col("o").startswith('"'), F.col("o")).otherwise(name("o"))
    lines = triplify.geo(spark, sf_dir).select(F.concat_ws(" ", name("s"), name("p"), o, F.lit(".")).alias("value"))
    return text.turtle(lines.union(spark.createDataFrame([("@prefix ex: <http://example.org/> .",)], "value string")))


@query(f"WITH {GEO} SELECT s, p, o FROM geo")
def csv_parse(spark, sf_dir):
    return text.csv(triplify.geo(spark, sf_dir).select(F.concat_ws(",", "s", "p", "o", F.lit("more")).alias("value")))


@query("""WITH t AS (SELECT 'customer/' || c_custkey AS s, CASE WHEN c_custkey % 7 <> 0 THEN 'segment' END AS p,
  CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS o FROM customer)
SELECT 'empty' AS policy, s, coalesce(p, '') AS p, coalesce(o, '') AS o FROM t
UNION ALL SELECT 'drop', s, p, o FROM t WHERE p IS NOT NULL AND o IS NOT NULL""")
def table_null_policies(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    t = c.select(triplify.node("customer", "c_custkey").alias("subject"), F.when(F.col("c_custkey") % 7 != 0, "segment").alias("predicate"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("object"))
    both = [tables.from_table(t, k).select(F.lit(k).alias("policy"), "s", "p", "o") for k in ("empty", "drop")]
    return both[0].union(both[1])


@query(f"WITH {GEO} SELECT DISTINCT o AS s, s AS o FROM geo WHERE p = 'inNation'")
def rule_inverse(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "has(?n, ?c) :- inNation(?c, ?n).", "has")


@query(f"WITH {GEO} SELECT s, o FROM geo WHERE p = 'inRegion' UNION SELECT o, s FROM geo WHERE p = 'inRegion'")
def rule_union_symmetric(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "adj(?x, ?y) :- inRegion(?x, ?y).\nadj(?x, ?y) :- inRegion(?y, ?x).", "adj")


@query(f"WITH {GEO} SELECT DISTINCT s FROM geo WHERE p = 'inNation' AND o = 'nation/5'")
def rule_const_object(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "in5(?x) :- inNation(?x, nation/5).", "in5", 1)


@query(f"WITH {FOLLOWS} SELECT s FROM fol WHERE s = o")
def rule_self_loop(spark, sf_dir):
    return derived(triplify.event_types(spark, sf_dir), "loop(?x) :- followedBy(?x, ?x).", "loop", 1)


@query(f"WITH {GEO} SELECT s, o FROM geo WHERE p = 'inRegion' AND EXISTS (SELECT 1 FROM geo WHERE s = 'nation/5' AND p = 'inRegion' AND o = 'region/0')")
def rule_ground_guard(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "ok(?x, ?y) :- inRegion(nation/5, region/0), inRegion(?x, ?y).", "ok")


@query(f"WITH {GEO} SELECT DISTINCT a.s, b.o FROM geo a JOIN geo b ON a.o = b.s WHERE a.p = 'inNation' AND b.p = 'inRegion'")
def rule_path2(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "at(?x, ?r) :- inNation(?x, ?n), inRegion(?n, ?r).", "at")


@query("""SELECT DISTINCT 'order/' || o_orderkey AS s, 'region/' || n_regionkey AS o
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""")
def rule_path3(spark, sf_dir):
    graph = triplify.geo(spark, sf_dir).union(triplify.trade(spark, sf_dir))
    return derived(graph, "to(?x, ?r) :- placedBy(?x, ?c), inNation(?c, ?n), inRegion(?n, ?r).", "to")


@query(f"WITH {GEO} SELECT DISTINCT a.s, b.s AS o FROM geo a JOIN geo b ON a.o = b.o WHERE a.p = 'inRegion' AND b.p = 'inRegion'")
def rule_sibling(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "sib(?x, ?y) :- inRegion(?x, ?r), inRegion(?y, ?r).", "sib")


@query(f"""WITH {ORDERS} SELECT DISTINCT 'customer/' || ck AS s FROM placed JOIN sold USING (k)
JOIN customer ON c_custkey = ck JOIN supplier ON s_suppkey = sk AND s_nationkey = c_nationkey""")
def rule_semijoin_local_buyer(spark, sf_dir):
    graph = triplify.geo(spark, sf_dir).union(triplify.trade(spark, sf_dir))
    return derived(graph, "local(?c) :- placedBy(?o, ?c), soldBy(?o, ?s), inNation(?c, ?n), inNation(?s, ?n).", "local", 1)


@query(f"""WITH {ORDERS} SELECT DISTINCT 'customer/' || ck AS s, 'supplier/' || sk AS o FROM placed JOIN sold USING (k)
JOIN customer ON c_custkey = ck JOIN supplier ON s_suppkey = sk AND s_nationkey = c_nationkey""")
def rule_cycle_cust_supp(spark, sf_dir):
    graph = triplify.geo(spark, sf_dir).union(triplify.trade(spark, sf_dir))
    return derived(graph, "near(?c, ?s) :- placedBy(?o, ?c), soldBy(?o, ?s), inNation(?c, ?n), inNation(?s, ?n).", "near")


@query(f"WITH {GEO}, r AS (SELECT DISTINCT o FROM geo WHERE p = 'inRegion') SELECT a.o AS s, b.o FROM r a CROSS JOIN r b")
def rule_cross_product(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "both(?a, ?b) :- inRegion(?x, ?a), inRegion(?y, ?b).", "both")


LOCATED = "loc(?x, ?y) :- inNation(?x, ?y).\nloc(?x, ?y) :- inRegion(?x, ?y).\nloc(?x, ?z) :- loc(?x, ?y), loc(?y, ?z)."
LOCATED_SQL = f"""WITH RECURSIVE {GEO}, e AS (SELECT s, o FROM geo WHERE p IN ('inNation', 'inRegion')),
r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r"""


@query(LOCATED_SQL)
def located_in_closure(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), LOCATED, "loc")


NEXT_SQL = f"WITH RECURSIVE {NEXT}, r AS (SELECT s, o FROM nxt UNION SELECT r.s, nxt.o FROM r JOIN nxt ON r.o = nxt.s) SELECT s, o FROM r"
for shape, step in {"right": "next(?x, ?y), reach(?y, ?z)", "left": "reach(?x, ?y), next(?y, ?z)", "nonlinear": "reach(?x, ?y), reach(?y, ?z)"}.items():

    def conv_reach(spark, sf_dir, step=step):
        return derived(triplify.turns(spark, sf_dir), f"reach(?x, ?y) :- next(?x, ?y).\nreach(?x, ?z) :- {step}.", "reach")

    conv_reach.__name__ = f"conv_reach_{shape}"
    query(NEXT_SQL)(conv_reach)


@query(f"WITH RECURSIVE {FOLLOWS}, r AS (SELECT s, o FROM fol UNION SELECT r.s, fol.o FROM r JOIN fol ON r.o = fol.s) SELECT s, o FROM r")
def followed_by_closure(spark, sf_dir):
    return derived(triplify.event_types(spark, sf_dir), "after(?x, ?y) :- followedBy(?x, ?y).\nafter(?x, ?z) :- after(?x, ?y), followedBy(?y, ?z).", "after")


@query(f"""WITH RECURSIVE {GEO}, e AS (SELECT s, o FROM geo WHERE p = 'inRegion' UNION SELECT o, s FROM geo WHERE p = 'inRegion'),
r AS (SELECT s, o FROM e UNION SELECT r.s, e.o FROM r JOIN e ON r.o = e.s) SELECT s, o FROM r""")
def equivalence_closure(spark, sf_dir):
    rules = "eq(?x, ?y) :- inRegion(?x, ?y).\neq(?x, ?y) :- eq(?y, ?x).\neq(?x, ?z) :- eq(?x, ?y), eq(?y, ?z)."
    return derived(triplify.geo(spark, sf_dir), rules, "eq")


@query(f"""WITH RECURSIVE {NEXT}, r AS (SELECT s, o, 1 AS odd FROM nxt UNION SELECT r.s, nxt.o, 1 - odd FROM r JOIN nxt ON r.o = nxt.s)
SELECT s, o FROM r WHERE odd = 0""")
def even_path(spark, sf_dir):
    rules = "odd(?x, ?y) :- next(?x, ?y).\neven(?x, ?z) :- odd(?x, ?y), next(?y, ?z).\nodd(?x, ?z) :- even(?x, ?y), next(?y, ?z)."
    return derived(triplify.turns(spark, sf_dir), rules, "even")


@query(f"""WITH RECURSIVE {GEO}, up AS (SELECT s, o FROM geo WHERE (p = 'inNation' AND s LIKE 'supplier/%') OR p = 'inRegion'),
r AS (SELECT a.s, b.s AS o FROM up a JOIN up b ON a.o = b.o
  UNION SELECT a.s, b.s FROM r JOIN up a ON a.o = r.s JOIN up b ON b.o = r.o) SELECT s, o FROM r""")
def same_generation(spark, sf_dir):
    g = triplify.geo(spark, sf_dir)
    up = g.filter(((F.col("p") == "inNation") & F.col("s").startswith("supplier/")) | (F.col("p") == "inRegion")).withColumn("p", F.lit("up"))
    return derived(up, "sg(?x, ?y) :- up(?x, ?z), up(?y, ?z).\nsg(?x, ?y) :- up(?x, ?a), sg(?a, ?b), up(?y, ?b).", "sg")


@query(LOCATED_SQL)
def incremental_equals_full(spark, sf_dir):
    """The closure over customers' and suppliers' nations, then extended by the regions."""
    g, program = triplify.geo(spark, sf_dir), parse_program(LOCATED)
    base, late = TripleStore(g.filter("p <> 'inRegion'")), TripleStore(g.filter("p = 'inRegion'"))
    return reason(base, program, new_facts=late, known=reason(base, program)).relation("loc")


@query(f"WITH {GEO} SELECT DISTINCT s, o FROM geo WHERE p = 'inRegion' UNION SELECT s, o FROM geo WHERE p = 'name'")
def store_add_remove(spark, sf_dir):
    g = TripleStore(triplify.geo(spark, sf_dir))
    return g.remove(g.by_predicate("inNation")).df.select("s", "o").distinct()


OWN_SQL = f"""WITH RECURSIVE {NEXT}, own AS (
  SELECT 'start/' || conv_id AS s, 'conv/' || conv_id || '/1' AS o FROM conversations WHERE turn = 1
  UNION SELECT 'conv/' || conv_id || '/2', 'mark/' || conv_id FROM conversations WHERE turn = 2),
base AS (SELECT s, o FROM nxt UNION SELECT s, o FROM own),
r AS (SELECT s, o FROM base UNION SELECT %s) SELECT s, o FROM r"""
LEFT_SQL, RIGHT_SQL = OWN_SQL % "r.s, nxt.o FROM r JOIN nxt ON r.o = nxt.s", OWN_SQL % "nxt.s, r.o FROM nxt JOIN r ON nxt.o = r.s"
REACH_LEFT = "reach(?x, ?y) :- next(?x, ?y).\nreach(?x, ?z) :- reach(?x, ?y), next(?y, ?z)."
REACH_RIGHT = "reach(?x, ?y) :- next(?x, ?y).\nreach(?x, ?z) :- next(?x, ?y), reach(?y, ?z)."


def _own_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of the closure's own predicate, before the first turn and after the second."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    id_ = F.col("conv_id").cast("string")
    start = c.filter("turn = 1").select(F.concat(F.lit("start/"), id_).alias("s"), F.lit("reach").alias("p"), F.concat(F.lit("conv/"), id_, F.lit("/1")).alias("o"))
    mark = c.filter("turn = 2").select(F.concat(F.lit("conv/"), id_, F.lit("/2")).alias("s"), F.lit("reach").alias("p"), F.concat(F.lit("mark/"), id_).alias("o"))
    return start.union(mark)


@query(LEFT_SQL)
def closure_with_head_facts(spark, sf_dir):
    return derived(triplify.turns(spark, sf_dir).union(_own_facts(spark, sf_dir)), REACH_LEFT, "reach")


@query(RIGHT_SQL)
def closure_with_head_facts_right(spark, sf_dir):
    return derived(triplify.turns(spark, sf_dir).union(_own_facts(spark, sf_dir)), REACH_RIGHT, "reach")


@query(LEFT_SQL)
def closure_with_new_head_facts(spark, sf_dir):
    base, program = TripleStore(triplify.turns(spark, sf_dir)), parse_program(REACH_LEFT)
    return reason(base, program, new_facts=TripleStore(_own_facts(spark, sf_dir)), known=reason(base, program)).relation("reach")


RDF = "PREFIX rdf: <http://www.w3.org/1999/02/22-rdf-syntax-ns#>\n"
FIFTH = "in5(?x) :- inNation(?x, nation/5).\nrdf:type(?x, placed) :- inNation(?x, ?n).\n"


@query(f"""WITH {GEO}, h AS (SELECT DISTINCT s, 'five' AS o FROM geo WHERE p = 'inNation' AND o = 'nation/5'
UNION SELECT s, 'placed' FROM geo WHERE p = 'inNation') SELECT s, o FROM h""")
def rule_type_unary(spark, sf_dir):
    """A class derived by one notation and read by the other, both ways."""
    rules = RDF + FIFTH + "h(?x, five) :- rdf:type(?x, in5).\nh(?x, placed) :- placed(?x)."
    return derived(triplify.geo(spark, sf_dir), rules, "h")


@query(f"""WITH {GEO} SELECT DISTINCT s, 'in5' AS o FROM geo WHERE p = 'inNation' AND o = 'nation/5'
UNION SELECT s, 'placed' FROM geo WHERE p = 'inNation'""")
def rule_class_variable(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), RDF + FIFTH + "is(?x, ?c) :- rdf:type(?x, ?c).", "is")


@query(f"WITH {GEO} SELECT DISTINCT p AS s, o FROM geo WHERE s = 'nation/5'")
def rule_predicate_variable(spark, sf_dir):
    return derived(triplify.geo(spark, sf_dir), "about5(?p, ?y) :- ?p(nation/5, ?y).", "about5")


@query(f"WITH {GEO} SELECT DISTINCT s, o FROM geo WHERE p IN ('inNation', 'inRegion')")
def rule_subproperties(spark, sf_dir):
    """A predicate variable in a head: what holds of a predicate holds of those above it."""
    above = spark.createDataFrame([("inNation", "sub", "within"), ("inRegion", "sub", "within"), ("within", "sub", "at")], "s string, p string, o string")
    return derived(triplify.geo(spark, sf_dir).union(above), "?q(?x, ?y) :- sub(?p, ?q), ?p(?x, ?y).", "at")


@query(f"WITH {GEO} SELECT DISTINCT o AS s, s AS o FROM geo WHERE p = 'inNation'")
def rule_from_code(spark, sf_dir):
    rule = Rule(Atom("has", (Var("n"), Var("c"))), (Atom("inNation", (Var("c"), Var("n"))),))
    return reason(TripleStore(triplify.geo(spark, sf_dir)), Program([rule])).relation("has")


@query(ORACLES["rule_path3"])
def rule_path3_statistics(spark, sf_dir):
    graph = triplify.geo(spark, sf_dir).union(triplify.trade(spark, sf_dir))
    program = parse_program("to(?x, ?r) :- placedBy(?x, ?c), inNation(?c, ?n), inRegion(?n, ?r).")
    return reason(TripleStore(graph), program, statistics=True).relation("to")


@query(LOCATED_SQL)
def rule_file(spark, sf_dir):
    path = os.path.join(_local(scratch(spark, "rules")), "located.dl")
    os.makedirs(os.path.dirname(path))
    with open(path, "w", encoding="utf-8") as f:
        f.write(f"# where things are\n{LOCATED}\n")
    return reason(TripleStore(triplify.geo(spark, sf_dir)), read_program(path)).relation("loc")


def _local(uri: str) -> str:
    """The shared folder as a path of this machine, for what isn't read by Spark."""
    return uri.removeprefix("file://").removeprefix("file:")


@query(f"""WITH RECURSIVE {NEXT}, r AS (SELECT s, o, 0 AS number FROM nxt UNION SELECT r.s, nxt.o, r.number + 1 FROM r JOIN nxt ON r.o = nxt.s),
n AS (SELECT number, count(*) AS new_rows FROM r GROUP BY number)
SELECT number::INT AS number, new_rows::BIGINT AS new_rows FROM n UNION ALL SELECT (max(number) + 1)::INT, 0 FROM n""")
def reason_statistics(spark, sf_dir):
    """What each round of two mutually recursive predicates found, the last nothing."""
    rules = "odd(?x, ?y) :- next(?x, ?y).\neven(?x, ?z) :- odd(?x, ?y), next(?y, ?z).\nodd(?x, ?z) :- even(?x, ?y), next(?y, ?z)."
    rounds = reason(TripleStore(triplify.turns(spark, sf_dir)), parse_program(rules), max_rounds=50).rounds
    return spark.createDataFrame([(r.number, r.new_rows) for r in rounds], "number int, new_rows long")


@query(f"WITH {GEO} SELECT s, p, o FROM geo UNION ALL SELECT s, '', o FROM geo WHERE p = 'inRegion' UNION ALL SELECT s, repeat('long', 100), o FROM geo WHERE p = 'inRegion'")
def store_write_read(spark, sf_dir):
    """Predicates that are empty, or longer than a folder's name can be, are kept."""
    g, path = triplify.geo(spark, sf_dir), scratch(spark, "store")
    regions = g.filter("p = 'inRegion'")
    TripleStore(g.union(regions.withColumn("p", F.lit(""))).union(regions.withColumn("p", F.lit("long" * 100)))).write(path)
    return TripleStore.read(spark, path).df


@query(f"WITH {GEO} SELECT s, p, o FROM geo WHERE p = 'inRegion'")
def store_read_predicate(spark, sf_dir):
    path = scratch(spark, "store")
    TripleStore(triplify.geo(spark, sf_dir)).write(path)
    return TripleStore.read(spark, path).by_predicate("inRegion")


@query(f"""WITH {GEO}, n AS (SELECT (row_number() OVER (ORDER BY s, p, o) - 1)::BIGINT AS row_id, s, p, o FROM geo)
SELECT row_id, s, p, o FROM n WHERE row_id % 7 = 3""")
def fetch_by_position(spark, sf_dir):
    store = TripleStore(triplify.geo(spark, sf_dir))
    return store.fetch(spark.range(0, 1 << 20).filter("id % 7 = 3"))


@query(f"""WITH {GEO}, terms AS (SELECT s AS t FROM geo UNION SELECT p FROM geo UNION SELECT o FROM geo),
ids AS (SELECT t AS term, (row_number() OVER (ORDER BY t) - 1)::BIGINT AS id FROM terms),
probe AS (SELECT 'nation/' || c_custkey AS term FROM customer) SELECT probe.term, id FROM probe LEFT JOIN ids USING (term)""")
def dictionary_lookup(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return TermDictionary.build(triplify.geo(spark, sf_dir)).lookup(c.select(triplify.node("nation", "c_custkey").alias("term")))


@query(f"""WITH {GEO}, terms AS (SELECT s AS term FROM geo UNION SELECT p FROM geo UNION SELECT o FROM geo)
SELECT 'nation/' || c_custkey AS term FROM customer WHERE 'nation/' || c_custkey IN (SELECT term FROM terms)""")
def dictionary_contains(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return TermDictionary.build(triplify.geo(spark, sf_dir)).contains(c.select(triplify.node("nation", "c_custkey").alias("term")))


@query(f"""WITH {GEO}, terms AS (SELECT s AS term FROM geo UNION SELECT p FROM geo UNION SELECT o FROM geo)
SELECT count(*)::BIGINT AS n FROM terms""")
def dictionary_size(spark, sf_dir):
    return spark.createDataFrame([(TermDictionary.build(triplify.geo(spark, sf_dir)).size(),)], "n long")


@query(ORACLES["ntriples_parse"])
def ntriples_file(spark, sf_dir):
    path = scratch(spark, "ntriples")
    text.write_ntriples(ntriples_parse(spark, sf_dir), path)
    return text.read_ntriples(spark, path)


@query(f"""WITH {GEO}, r AS (SELECT s, o FROM geo WHERE p = 'inRegion')
SELECT 'http://a/' || s AS s, 'http://a/in' AS p, 'http://a/' || o AS o FROM r
UNION ALL SELECT 'http://b/' || s, 'http://b/in', 'http://b/' || o FROM r""")
def turtle_two_files(spark, sf_dir):
    """Two files that declare the same name differently."""
    path = scratch(spark, "turtle")
    lines = triplify.geo(spark, sf_dir).filter("p = 'inRegion'").select(F.concat(F.lit("ex:"), "s", F.lit(" ex:in ex:"), "o", F.lit(" .")).alias("value"))
    for name in "ab":
        first = spark.createDataFrame([(f"@prefix ex: <http://{name}/> .",)], "value string")
        first.union(lines).coalesce(1).write.text(f"{path}/{name}")
    return text.read_turtle(spark, f"{path}/*")


@query("""SELECT 'http://example.org/nation/' || n_nationkey AS s, 'http://example.org/inRegion' AS p, 'http://example.org/region/' || n_regionkey AS o FROM nation
UNION ALL SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/name', '"' || n_name || '"' FROM nation
UNION ALL SELECT 'http://example.org/nation/' || n_nationkey, 'http://example.org/key', '"' || n_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' FROM nation""")
def turtle_documents(spark, sf_dir):
    """A document for each nation, with a base, a list of properties over lines, and a number."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    key = F.col("n_nationkey").cast("string")
    lines = F.concat_ws("\n", F.lit("@base <http://example.org/> ."), F.concat(F.lit("<nation/"), key, F.lit("> <inRegion> <region/"), F.col("n_regionkey").cast("string"), F.lit("> ;")), F.concat(F.lit(' <name> "'), "n_name", F.lit('" ; <key> '), key, F.lit(" .")))
    return documents(n.select(triplify.node("nation", "n_nationkey").alias("path"), lines.alias("value")))


@query(f"WITH {GEO} SELECT s, p, o FROM geo")
def csv_file(spark, sf_dir):
    path = scratch(spark, "csv")
    triplify.geo(spark, sf_dir).select(F.concat_ws(",", "s", "p", "o", F.lit("more")).alias("value")).write.text(path)
    return text.read_csv(spark, path)


ROWS_SQL = """SELECT 'customer/' || c_custkey AS s, %s AS p, %s AS o FROM customer%s"""
EMPTY_SQL = ROWS_SQL % ("coalesce(CASE WHEN c_custkey % 7 <> 0 THEN 'segment' END, '')", "coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, '')", "")
DROP_SQL = ROWS_SQL % ("'segment'", "c_mktsegment", " WHERE c_custkey % 7 <> 0 AND c_custkey % 5 <> 0")


def _database(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, dict[str, str]]:
    """A database with a table of triples some of whose fields are null.

    A database in memory, or in a folder, belongs to one process. So the driver loads a
    folder from files that tasks wrote and packs it: any number of processes may read an archive.
    """
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    rows = c.select(F.col("c_custkey").alias("id"), triplify.node("customer", "c_custkey").alias("subject"), F.when(F.col("c_custkey") % 7 != 0, "segment").alias("predicate"), F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment")).alias("object"))
    loaded = scratch(spark, "jdbc")
    rows.write.csv(loaded, emptyValue='""', escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)  # a null is an empty field
    base, driver = _local(scratch(spark, "derby")), spark._jvm.org.apache.derby.jdbc.EmbeddedDriver()
    none = spark._jvm.java.util.Properties()
    db = driver.connect(f"jdbc:derby:directory:{base}/{name};create=true", none)
    statement = db.createStatement()
    statement.execute('CREATE TABLE facts("id" BIGINT, "subject" VARCHAR(32672), "predicate" VARCHAR(32672), "object" VARCHAR(32672))')
    for part in sorted(Path(_local(loaded)).glob("part-*")):
        statement.execute(f"""CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE(NULL, 'FACTS', '{str(part).replace("'", "''")}', ',', '"', 'UTF-8', 0)""")
    db.close()
    try:
        driver.connect(f"jdbc:derby:directory:{base}/{name};shutdown=true", none)
    except Py4JJavaError as e:
        if e.java_exception.getSQLState() != "08006":  # how Derby says that it shut down
            raise
    with zipfile.ZipFile(f"{base}.jar", "w", zipfile.ZIP_STORED) as z:
        for f in sorted(Path(base).rglob("*")):
            if f.suffix != ".lck":
                z.write(f, f.relative_to(base))
    discard(spark, loaded)
    shutil.rmtree(base)
    return f"jdbc:derby:jar:({base}.jar){name}", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@query(EMPTY_SQL)
def jdbc_table(spark, sf_dir):
    url, properties = _database(spark, sf_dir, "whole")
    return tables.read_jdbc(spark, url, "facts", properties=properties)


@query(EMPTY_SQL)
def jdbc_by_ranges(spark, sf_dir):
    url, properties = _database(spark, sf_dir, "ranges")
    return tables.read_jdbc(spark, url, "facts", partition_column="id", bounds=(1, 1000), partitions=4, properties=properties)


@query(DROP_SQL)
def jdbc_by_predicates(spark, sf_dir):
    url, properties = _database(spark, sf_dir, "predicates")
    return tables.read_jdbc(spark, url, "facts", nulls="drop", predicates=['"id" < 100', '"id" >= 100 AND "id" < 700', '"id" >= 700'], properties=properties)


@query("""SELECT 'nation/' || n_nationkey AS s, 'inRegion' AS p, 'region/' || n_regionkey AS o FROM nation WHERE n_nationkey % 4 <> 0""")
def sqlite_table(spark, sf_dir):
    """The 25 nations, those of every fourth key without an object."""
    path = f"{_local(scratch(spark, 'sqlite'))}.db"
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE facts(subject, predicate, object)")
        db.executemany("INSERT INTO facts VALUES (?, 'inRegion', ?)", [(f"nation/{n}", f"region/{r}" if n % 4 else None) for n, r in rows])
    return tables.read_sqlite(spark, path, "facts", rows=10)


PEOPLE = """knows AS (SELECT 'person/' || (i % 1000) AS s, 'person/' || ((i * 7919 + (i * i) % 10007 * 31 + 13) % 1000) AS o FROM range(2000) AS t(i)),
parents AS (SELECT 'person/' || (i - 1 - (i * 31) % 17 % (i - 1)) AS s, 'person/' || i AS o FROM range(2, 1000) AS t(i) WHERE i % 3 = 0)"""


@query(f"WITH RECURSIVE {PEOPLE}, r AS (SELECT s, o FROM knows UNION SELECT r.s, knows.o FROM r JOIN knows ON r.o = knows.s) SELECT s, o FROM r")
def knows_closure(spark, sf_dir):
    """A closure with long cycles, far larger than its edges."""
    return derived(triplify.people(spark), "reach(?x, ?y) :- knows(?x, ?y).\nreach(?x, ?z) :- reach(?x, ?y), knows(?y, ?z).", "reach")


@query(f"WITH RECURSIVE {PEOPLE}, r AS (SELECT s, o FROM parents UNION SELECT r.s, parents.o FROM r JOIN parents ON r.o = parents.s) SELECT s, o FROM r")
def parents_closure(spark, sf_dir):
    return derived(triplify.people(spark), "above(?x, ?y) :- parentOf(?x, ?y).\nabove(?x, ?z) :- parentOf(?x, ?y), above(?y, ?z).", "above")


def entry(spark: SparkSession) -> DataFrame:
    return located_in_closure(spark, "/root/testdata/sf0.001")
