"""Quality rules as weak supervision, in DataFrame functions only.

Each rule votes good (1), bad (-1) or abstains (0), where it doesn't apply or its measure is
neither clearly good nor clearly bad; abstaining is no evidence. Documents are taken to be
good or of one of a few kinds of bad text, in each of which a rule votes bad with its own
probability. Expectation-maximisation estimates these probabilities and the share of each
kind over the table of vote patterns, which has at most 3^rules rows; nothing is given but
where it starts. The posterior probability of the good kind replaces having to pass all
rules: a bad vote counts as much as the rule's estimated accuracy says.
"""

from __future__ import annotations

from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.columns import let
from loomgraph.llm.shared import cut

SPACE, WINDOW, ROUNDS = r"[\x20\x09-\x0D]+", 5, 60
MARKS = "#*$%&|<>"
#: Words without a letter.
UNLETTERED = r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])"


def repeated_words(words: Column) -> Column:
    """How many words lie in windows of five words that stand twice or more in the text.

    Windows are compared by 64-bit hash; the sorted (hash, place) pairs show repeated ones
    next to each other, and the length of their union is summed from place to place.
    """

    def hashes(w: Column) -> Column:
        each = F.transform(w, lambda x: F.xxhash64(x))  # a word is hashed once, not in each of its windows
        return let(each, lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        same = lambda p, x, k: F.coalesce(F.get(p, k)["h"] == x["h"], F.lit(False))
        twice = lambda p: F.filter(p, lambda x, k: same(p, x, k + 1) | same(p, x, k - 1))
        places = lambda p: F.sort_array(F.transform(twice(p), lambda x: x["i"]))
        steps = lambda at: F.transform(at, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - x, F.lit(WINDOW))))
        total = lambda at: F.aggregate(steps(at), F.lit(0), lambda a, x: a + x)
        return let(pairs, lambda p: let(places(p), total))

    count = lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0))
    return let(words, lambda w: F.when(F.size(w) > WINDOW, let(hashes(w), count)).otherwise(F.lit(0))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the contract and those that the other rules need; null text has no word."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    count = lambda chars: F.regexp_count("text", F.lit(f"[{chars}]")).cast("long")
    length = F.length("text")
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.withColumn("words", F.filter(F.split("text", SPACE, -1), lambda w: w != ""))
    return d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        (length - count(r"\x20\x09-\x0D")).cast("long").alias("word_chars"),
        count(MARKS).alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(lines).cast("long").alias("n_lines"),
        count("A-Z").alias("n_upper"),
        count("!").alias("n_shouts"),
        count(".?").alias("n_stops"),
        (length - F.length(F.regexp_replace("text", r"\p{L}++", ""))).cast("long").alias("n_letters"),
        F.regexp_count("text", F.lit(UNLETTERED)).cast("long").alias("n_unlettered"),
    )


def rules() -> dict[str, tuple[int, Column]]:
    """For each rule the kind of bad text that it starts from, and its vote from the measures; n_words may be 0."""
    c, words = F.col, F.greatest(F.col("n_words"), F.lit(1))
    vote = lambda bad, good: F.when(bad, -1).when(good, 1).otherwise(0)
    mean, lines, chars = c("word_chars") / words, c("n_lines"), c("word_chars")
    return {
        "length": (1, vote(c("n_words") < 10, c("n_words") >= 50)),
        "sentences": (1, vote((c("n_words") >= 30) & (c("n_stops") * 60 < c("n_words")), (c("n_words") >= 30) & (c("n_stops") * 30 >= c("n_words")))),
        "word_length": (2, vote((mean < 3) | (mean > 10), mean.between(4, 7))),
        "symbols": (2, vote(c("n_symbols") > 0.1 * words, c("n_symbols") <= 0.01 * words)),
        "letters": (2, vote(c("n_letters") < 0.75 * chars, c("n_letters") >= 0.85 * chars)),
        "lettered_words": (2, vote(c("n_unlettered") > 0.2 * words, c("n_unlettered") <= 0.05 * words)),
        "repeated_lines": (3, vote((lines > 1) & (c("n_dup_lines") > 0.3 * lines), (lines > 1) & (c("n_dup_lines") <= 0.05 * lines))),
        "repeated_words": (3, vote((c("n_words") >= 5) & (c("n_repeat_words") > 0.2 * words), (c("n_words") >= 5) & (c("n_repeat_words") <= 0.05 * words))),
        "capitals": (4, vote(c("n_upper") > 0.3 * chars, (chars > 0) & (c("n_upper") <= 0.1 * chars))),
        "shouting": (4, vote(c("n_shouts") > 0.1 * words, (c("n_words") >= 10) & (c("n_shouts") <= 0.02 * words))),
    }


class Fit:
    """share of each kind, the good one first, and for each kind each rule's P(votes bad | it votes).

    EM starts where half of the text is good, which few rules call bad, and each other kind
    is called bad mostly by its own rules.
    """

    def __init__(self, kinds: list[int]):
        n = max(kinds)
        self.share = [0.5] + [0.5 / n] * n
        self.bad = [[0.05] * len(kinds)] + [[0.7 if k == own else 0.1 for k in kinds] for own in range(1, n + 1)]

    def posteriors(self, votes: list[Column]) -> Column:
        """Array of P(kind | votes)."""

        numbers = lambda xs: f"array({', '.join(f'{x:.17g}D' for x in xs)})"
        kind = lambda share, bad: f"named_struct('share', {log(share):.17g}D, 'bad', {numbers(map(log, bad))}, 'good', {numbers(log(1 - b) for b in bad)})"
        table = F.expr(f"array({', '.join(map(kind, self.share, self.bad))})")
        places = F.sequence(F.lit(0), F.lit(len(votes) - 1))
        said = lambda k, v, i: F.when(F.get(v, i) < 0, F.get(k["bad"], i)).when(F.get(v, i) > 0, F.get(k["good"], i)).otherwise(0.0)
        logs = let(F.array(*votes), lambda v: F.transform(table, lambda k: F.aggregate(places, k["share"], lambda a, i: a + said(k, v, i))))
        scaled = let(logs, lambda x: let(F.array_max(x), lambda m: F.transform(x, lambda y: F.exp(y - m))))
        return let(scaled, lambda x: let(F.aggregate(x, F.lit(0.0), lambda a, y: a + y), lambda t: F.transform(x, lambda y: y / t)))

    def posterior(self, votes: list[Column]) -> Column:
        """P(good | votes)."""
        return F.get(self.posteriors(votes), F.lit(0))


def fit(votes: DataFrame, kinds: dict[str, int], rounds: int = ROUNDS, close: float = 1e-4) -> Fit:
    """EM over the counted vote patterns v_<rule>, until no share changes by more; each round is one aggregation to a row for each kind.

    Counts are smoothed by one vote for each answer. Without rows the start is returned.
    """
    out, names = Fit(list(kinds.values())), [f"v_{n}" for n in kinds]
    table = cut(votes.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("n")).coalesce(1))
    cols = [F.col(n) for n in names]
    for _ in range(rounds):
        rows = table.select("n", *names, F.posexplode(out.posteriors(cols)).alias("kind", "p"))
        mass = F.col("n") * F.col("p")
        sums = [F.sum(mass).alias("all"), *[F.sum(F.when(c < 0, mass).otherwise(0.0)).alias(f"bad{i}") for i, c in enumerate(cols)], *[F.sum(F.when(c > 0, mass).otherwise(0.0)).alias(f"good{i}") for i, c in enumerate(cols)]]
        found = sorted(rows.groupBy("kind").agg(*sums).collect(), key=lambda r: r.kind)  # a row for each kind
        if not found:
            break
        total, before = sum(r["all"] for r in found), out.share
        out.share = [(r["all"] + 1) / (total + len(found)) for r in found]
        out.bad = [[(r[f"bad{i}"] + 1) / (r[f"bad{i}"] + r[f"good{i}"] + 2) for i in range(len(cols))] for r in found]
        if max(abs(a - b) for a, b in zip(before, out.share, strict=True)) < close:
            break
    return out


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Every row's measures, its base_failed, the posterior probability of good quality, and kept.

    base_failed (fewer than 10 words, or over a fifth of them in repeated windows) is never
    kept; else rows are whose posterior is at least the bound, equality included. Null and
    empty texts have no word and are base_failed. Texts are read whole, however long.
    Repeated rows are judged, and counted by EM, as often as they stand; a null doc_id is
    carried; other columns are ignored; an empty table gives none.
    """
    ballots = rules()
    table = cut(measures(docs).select("*", *[v.alias(f"v_{n}") for n, (_, v) in ballots.items()]))
    p = fit(table, {n: k for n, (k, _) in ballots.items()}).posterior([F.col(f"v_{n}") for n in ballots])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), p.alias("quality")).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
