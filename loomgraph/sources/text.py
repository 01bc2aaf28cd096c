"""N-Triples, Turtle lines and CSV as DataFrames of s, p, o.

Each format is a function from a DataFrame of lines (column value) to triples, so that any
source of lines can be used; read_* apply it to text files. Lines that aren't triples are
skipped, or with mode="failfast" end the query; rejected() returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.terms import canonical, expand_prefix
from loomgraph.operators.dictionary import BROADCAST_BYTES, SALTS
from loomgraph.session import cut

IRI = r"<[^<>\s]*>"
BLANK = r"_:\S*[^\s.]"
LITERAL = r'"(?:[^"\\]|\\.)*"'
SUFFIX = r"(?:@[A-Za-z]+(?:-[A-Za-z0-9]+)*|\^\^(?:<[^<>\s]*>|[^\s<>\"]*[^\s<>\".]))?"
NTRIPLES = rf"^\s*({IRI}|{BLANK})\s+({IRI})\s+({IRI}|{BLANK}|{LITERAL}{SUFFIX})\s*\.\s*(?:#.*)?$"
NAME = r"[^\s:<>\"@#,;\[\]()]*:[^\s<>\",;\[\]()]*[^\s<>\".,;\[\]()]"
TURTLE = rf"^\s*({IRI}|{BLANK}|{NAME})\s+({IRI}|{NAME}|a)\s+({IRI}|{BLANK}|{LITERAL}{SUFFIX}|{NAME})\s*\.\s*(?:#.*)?$"
PREFIX = r"^\s*(?:@prefix|@PREFIX|PREFIX|prefix)\s+([^\s:<>]*):\s*<([^<>\s]*)>\s*\.?\s*$"
RDF_TYPE = "<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"


def _matched(lines: DataFrame, pattern: str, mode: str, data: Column | None = None, more: list[Column] | None = None) -> DataFrame:
    """Columns g1, g2, g3, and more, of the lines that match; data: which lines should."""
    found = F.col("value").rlike(pattern)
    if mode == "failfast":
        should = data if data is not None else ~F.col("value").rlike(r"^\s*(#.*)?$")
        lines = lines.filter(should).withColumn("value", F.when(found, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200)))))
    else:
        lines = lines.filter(found)
    return lines.select(*[F.regexp_extract("value", pattern, k).alias(f"g{k}") for k in (1, 2, 3)], *(more or []))


def ntriples(lines: DataFrame, mode: str = "skip") -> DataFrame:
    """Terms in canonical form; blank-node subjects, language tags, datatypes and free spacing are accepted too."""
    return _matched(lines, NTRIPLES, mode).select(*[canonical(F.col(g)).alias(c) for g, c in (("g1", "s"), ("g2", "p"), ("g3", "o"))])


def prefixes(lines: DataFrame) -> dict[str, str]:
    """Declared names, wherever they stand; of a name declared twice the greatest IRI counts, as lines have no order."""
    found = lines.filter(F.col("value").rlike(PREFIX)).select(F.regexp_extract("value", PREFIX, 1).alias("name"), F.regexp_extract("value", PREFIX, 2).alias("iri"))
    return {r.name: r.iri for r in found.groupBy("name").agg(F.max("iri").alias("iri")).collect()}  # a row for each name


def prefixes_by_file(lines: DataFrame) -> DataFrame:
    """file, names (a map) of lines with file, start and n, which order them; of a name declared twice in a file the last counts."""
    found = lines.filter(F.col("value").rlike(PREFIX)).select(F.regexp_extract("value", PREFIX, 1).alias("name"), F.regexp_extract("value", PREFIX, 2).alias("iri"), "file", "start", "n")
    last = found.groupBy("file", "name").agg(F.max_by("iri", F.struct("start", "n")).alias("iri"))
    return last.groupBy("file").agg(F.map_from_entries(F.collect_list(F.struct("name", "iri"))).alias("names"))


def turtle(lines: DataFrame, names: dict[str, str] | Column | None = None, mode: str = "skip") -> DataFrame:
    """One complete triple a line; the keyword a is rdf:type; names (a dict, or a map column of lines) default to the declarations in lines."""
    names = prefixes(lines) if names is None else names
    data = ~F.col("value").rlike(r"^\s*(#.*)?$") & ~F.col("value").rlike(PREFIX)
    g = _matched(lines, TURTLE, mode, data, [] if isinstance(names, dict) else [names.alias("names")])
    g = g.withColumn("g2", F.when(F.col("g2") == "a", F.lit(RDF_TYPE)).otherwise(F.col("g2")))
    table = names if isinstance(names, dict) else F.col("names")
    return g.select(*[canonical(expand_prefix(F.col(x), table)).alias(c) for x, c in (("g1", "s"), ("g2", "p"), ("g3", "o"))])


def csv(lines: DataFrame, mode: str = "skip") -> DataFrame:
    """The first three comma-separated fields as they are: no header, quotes or trimming. An empty third field at the end of a line drops it."""
    parts = F.split("value", ",", -1)
    good = (F.size(parts) > 3) | ((F.size(parts) == 3) & (F.get(parts, F.lit(2)) != ""))
    if mode == "failfast":
        lines = lines.filter(F.col("value") != "").withColumn("value", F.when(good, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), F.substring("value", 1, 200)))))
    else:
        lines = lines.filter(good)
    return lines.select(*[F.get(parts, F.lit(i)).alias(c) for i, c in enumerate("spo")])


def rejected(lines: DataFrame, fmt: str) -> DataFrame:
    """The lines that a reader skips, without comments, blank lines and prefix declarations."""
    blank = F.col("value").rlike(r"^\s*$" if fmt == "csv" else r"^\s*(#.*)?$")
    if fmt == "csv":
        parts = F.split("value", ",", -1)
        good = (F.size(parts) > 3) | ((F.size(parts) == 3) & (F.get(parts, F.lit(2)) != ""))
    else:
        good = F.col("value").rlike(NTRIPLES if fmt == "ntriples" else TURTLE)
        blank = blank | (F.col("value").rlike(PREFIX) if fmt == "turtle" else F.lit(False))
    return lines.filter(~blank & ~good)


def read_ntriples(spark: SparkSession, path: str, mode: str = "skip") -> DataFrame:
    return ntriples(spark.read.text(path), mode)


def read_turtle(spark: SparkSession, path: str, mode: str = "skip") -> DataFrame:
    """Names hold in the file that declares them. Its map comes to each line by a join, broadcast if the maps are small, else salted, as one file may hold most lines."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    names = cut(prefixes_by_file(lines))
    pairs = F.aggregate(F.map_entries("names"), F.lit(0), lambda a, x: a + F.octet_length(x["key"]) + F.octet_length(x["value"]))
    size = names.agg(F.coalesce(F.sum(F.octet_length("file") + pairs + 64), F.lit(0)).alias("n")).first().n
    lines = lines.select("value", "file", F.pmod(F.xxhash64("n"), F.lit(SALTS)).cast("int").alias("salt"))
    if size <= BROADCAST_BYTES:
        lines = lines.join(F.broadcast(names), "file", "left")
    else:
        lines = lines.join(names.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["file", "salt"], "left")
    return turtle(lines, F.coalesce("names", F.create_map().cast("map<string,string>")), mode)


def read_csv(spark: SparkSession, path: str, mode: str = "skip") -> DataFrame:
    return csv(spark.read.text(path, lineSep="\n"), mode)


def write_ntriples(triples: DataFrame, path: str, mode: str = "errorifexists") -> None:
    def form(c: str) -> Column:
        return F.when(F.col(c).startswith('"') | F.col(c).startswith("_:"), F.col(c)).otherwise(F.concat(F.lit("<"), F.col(c), F.lit(">")))

    triples.select(F.concat_ws(" ", form("s"), form("p"), form("o"), F.lit(".")).alias("value")).write.mode(mode).text(path)
