"""Dense term ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph.operators.ranking import ranked
from loomgraph.session import cut

#: Ids of the predicates are broadcast if their terms have at most so many bytes in all.
BROADCAST_BYTES = 16 << 20
SALTS = 64


class TermDictionary:
    """term STRING, id LONG with ids dense from 0 in the order of terms."""

    def __init__(self, df: DataFrame):
        self.df = df

    @classmethod
    def build(cls, triples: DataFrame) -> TermDictionary:
        """Ids follow the terms' byte order; the table is written once."""
        terms = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).distinct()
        return cls(cut(ranked(terms, ["term"], "id").select("term", "id")))

    def _mapped(self, df: DataFrame, column: str, key: str, value: str) -> DataFrame:
        """df with <column>_new: the dictionary's value where its key is the column's."""
        return df.join(self.df.select(F.col(key).alias(column), F.col(value).alias(f"{column}_new")), column, "left")

    def _mapped_few(self, df: DataFrame, column: str, key: str, value: str) -> DataFrame:
        """The same for a column of few values, each of many rows: the side is broadcast if small, else hot values are salted."""
        side = cut(self.df.join(df.select(F.col(column).alias(key)).distinct(), key, "left_semi")).select(F.col(key).alias(column), F.col(value).alias(f"{column}_new"))
        size = side.agg(F.coalesce(F.sum(F.octet_length(F.col(column).cast("string")) + F.octet_length(F.col(f"{column}_new").cast("string")) + 16), F.lit(0)).alias("n")).first().n
        if size <= BROADCAST_BYTES:
            return df.join(F.broadcast(side), column, "left")
        salted = side.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(*df.columns), F.lit(SALTS)).cast("int")
        return df.withColumn("__salt", salt).join(salted, [column, "__salt"], "left").drop("__salt")

    def encode(self, triples: DataFrame) -> DataFrame:
        """s, p, o as ids; a term that isn't known is null."""
        out = self._mapped_few(triples.select("s", "p", "o"), "p", "term", "id")
        for c in ("s", "o"):
            out = self._mapped(out, c, "term", "id")
        return out.select(*[F.col(f"{c}_new").alias(c) for c in ("s", "p", "o")])

    def decode(self, ids: DataFrame) -> DataFrame:
        """s, p, o as terms; an unknown id is the empty string."""
        out = self._mapped_few(ids.select("s", "p", "o"), "p", "id", "term")
        for c in ("s", "o"):
            out = self._mapped(out, c, "id", "term")
        return out.select(*[F.coalesce(f"{c}_new", F.lit("")).alias(c) for c in ("s", "p", "o")])

    def contains(self, terms: DataFrame) -> DataFrame:
        return terms.join(self.df, "term", "left_semi")

    def lookup(self, terms: DataFrame) -> DataFrame:
        """term, id; id is null where absent."""
        return terms.join(self.df, "term", "left").select("term", "id")

    def size(self) -> int:
        return self.df.count()


def stats(triples: DataFrame) -> DataFrame:
    """unique_terms, total_bytes of distinct terms, occurrence_bytes and their ratio, in one row."""
    per = triples.select(F.explode(F.array("s", "p", "o")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    size = F.octet_length("term").cast("long")
    return per.agg(
        F.count(F.lit(1)).alias("unique_terms"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.sum(size * F.col("n")), F.lit(0)).cast("long").alias("occurrence_bytes"),
    ).withColumn("compression_ratio", F.when(F.col("total_bytes") > 0, F.col("occurrence_bytes") / F.col("total_bytes")))
