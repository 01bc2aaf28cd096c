"""Triples as an immutable DataFrame with lookups that push down to the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.terms import RDF_TYPE
from loomgraph.operators.ranking import ranked

COLUMNS = ["s", "p", "o"]
#: The predicate of a relation that holds all triples, as (s, p, o).
ANY = "?"
#: Folder names hold so many characters of a predicate; the whole of it is a column of the files.
KEY_CHARS = 40


def folder_key(p: Column) -> Column:
    """A folder name for a predicate that is neither empty nor too long for a file system."""
    return F.concat(F.lit("p"), F.substring(p, 1, KEY_CHARS))


class TripleStore:
    """A bag of (s, p, o) string triples.

    Rows with a null term aren't triples and are left out. Lookups are lazy filters;
    reasoning sees the set of triples.
    """

    def __init__(self, triples: DataFrame, key: str | None = None):
        """key: a column of triples with folder_key of the predicate, by which folders are pruned."""
        if len(triples.columns) < 3:
            raise ValueError("three columns are needed")
        names = COLUMNS if set(COLUMNS) <= set(triples.columns) else triples.columns[:3]
        self.df = triples.select(*[F.col(f"`{c}`").cast("string").alias(n) for c, n in zip(names, COLUMNS, strict=True)]).dropna()
        self._keyed = triples.dropna(subset=COLUMNS) if key else None
        self._key = key

    @classmethod
    def of(cls, spark: SparkSession, rows: list[tuple[str, str, str]]) -> TripleStore:
        return cls(spark.createDataFrame(rows, "s string, p string, o string"))

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> TripleStore:
        return cls(spark.read.schema("s string, p string, o string, folder string").parquet(path), "folder")

    def write(self, path: str, mode: str = "errorifexists") -> None:
        """A folder for each predicate (for those that begin alike one), sorted by predicate and subject.

        Predicate lookups prune folders, subject lookups row groups. Ranges of predicate and
        subject are dealt to the tasks, so a predicate that holds most of the rows is split.
        """
        keyed = self.df.withColumn("folder", folder_key(F.col("p")))
        keyed.repartitionByRange("folder", "p", "s", "o").sortWithinPartitions("folder", "p", "s").write.mode(mode).partitionBy("folder").parquet(path)

    def add(self, more: DataFrame | TripleStore) -> TripleStore:
        more = more if isinstance(more, TripleStore) else TripleStore(more)
        return TripleStore(self.df.unionByName(more.df))

    def remove(self, gone: DataFrame | TripleStore) -> TripleStore:
        gone = gone if isinstance(gone, TripleStore) else TripleStore(gone)
        return TripleStore(self.df.join(gone.df, COLUMNS, "left_anti"))

    def by_subject(self, term: str) -> DataFrame:
        return self.df.filter(F.col("s") == term)

    def by_predicate(self, term: str) -> DataFrame:
        if self._keyed is None:
            return self.df.filter(F.col("p") == term)
        return self._keyed.filter((F.col(self._key) == f"p{term[:KEY_CHARS]}") & (F.col("p") == term)).select(COLUMNS)

    def by_object(self, term: str) -> DataFrame:
        return self.df.filter(F.col("o") == term)

    def contains(self, s: str, p: str, o: str) -> bool:
        return not self.by_predicate(p).filter((F.col("s") == s) & (F.col("o") == o)).isEmpty()

    def contains_all(self, probes: DataFrame) -> DataFrame:
        """The probes that are in the store."""
        return probes.join(self.df, COLUMNS, "left_semi")

    def missing(self, probes: DataFrame) -> DataFrame:
        return probes.join(self.df, COLUMNS, "left_anti")

    def count(self, distinct: bool = False) -> int:
        return (self.df.distinct() if distinct else self.df).count()

    def predicate_counts(self, predicates: list[str] | None = None) -> DataFrame:
        """p, n; of the given predicates only, if any are given."""
        df = self.df.filter(F.col("p").isin(predicates)) if predicates is not None else self.df
        return df.groupBy("p").agg(F.count(F.lit(1)).alias("n"))

    def numbered(self) -> DataFrame:
        """row_id, s, p, o: positions dense from 0 in the order of s, p, o, the same in every run."""
        return ranked(self.df, COLUMNS, "row_id").select("row_id", *COLUMNS)

    def fetch(self, positions: DataFrame) -> DataFrame:
        """row_id, s, p, o of the wanted row_ids; positions that don't exist give no row."""
        return self.numbered().join(positions.select(F.col(positions.columns[0]).cast("long").alias("row_id")).distinct(), "row_id", "left_semi")

    def at(self, position: int) -> Row:
        """The triple at a position; IndexError if there is none."""
        found = self.numbered().filter(F.col("row_id") == position).select(COLUMNS).first()
        if found is None:
            raise IndexError(f"no triple at position {position}")
        return found

    def relation(self, predicate: str, arity: int = 2, distinct: bool = True) -> DataFrame:
        """The predicate's pairs (s, o); with arity 1 the members of the class, as s; of ANY all triples.

        As a set, or as a bag with distinct=False, which needs no shuffle.
        """
        if predicate == ANY:
            out = self.df
        elif arity == 1:
            out = self.by_predicate(RDF_TYPE).filter(F.col("o") == predicate).select("s")
        else:
            out = self.by_predicate(predicate).select("s", "o")
        return out.distinct() if distinct else out
