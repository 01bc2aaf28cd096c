"""Personal data by patterns and bootstrapped contexts, in DataFrame functions only.

Base spans are matches of fixed patterns. They, and tokens that look like digests or keys,
are the seeds of a bootstrap. Each place of a seed or of another identifier-like token (at
least three digits, or an @) belongs to three lexical patterns: the words left of it, the
word right of it, and its shape with the marks around it. A pattern of words is as reliable
as the share of its places in the corpus where such a token stands, a shape as the share of
trusted ones among its tokens, weighted down where few distinct trusted instances support
it; any pattern needs a fair share of trusted ones. An instance is trusted as far as the
patterns around it are (noisy or). Scores go back and forth over the aggregated
pattern-instance graph for a few rounds; instances found by trusted patterns become seeds
for further patterns. Instances that trusted patterns found add spans of kind "context"
wherever they stand; key-like seeds add none unless patterns find them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.llm.columns import cutter, let, scan
from loomgraph.llm.shared import BROADCAST_BYTES, cut, join_checked, join_hot

KINDS = ("email", "ip", "card", "phone", "context")
#: The same matches as the patterns of the contract. A run is entered at its first
#: character or where the match before ended (\G), and repeats are possessive, so no
#: run is scanned twice and long ones need no stack.
LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"(?<![0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
GAP, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
#: What looks like a digest or a key: at least 32 hexadecimal digits, some of them letters and some not.
KEY = r"^(?=[0-9]*[a-fA-F])(?=[a-fA-F]*[0-9])[0-9a-fA-F]{32,}$"
ROUNDS, LEAST_CONFIDENCE, LEAST_SEEDS, LEAST_TRUSTED, LONG = 3, 0.6, 3, 0.1, 64
SPAN = "array<struct<start:int,end:int,kind:int,value:string>>"
PLACE = "array<struct<start:int,end:int,value:string,left:string,right:string>>"
CANDIDATE = "array<struct<start:int,end:int,value:string,context:string,right:string,shape:string,key:boolean>>"
#: How many pairs of base spans and candidates of a text are compared one by one.
FEW = 4096


def located(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, left, right>> of the pattern's leftmost non-overlapping matches; left and right are the contexts."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    n = F.size(found)
    pairs = F.arrays_zip(F.slice(gaps, F.lit(1), n).alias("gap"), found.alias("value"), F.slice(gaps, F.lit(2), n).alias("after"))

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["value"])
        place = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), context_of(F.concat(state["last"], x["gap"])).alias("left"), following(x["after"]).alias("right"))
        return F.struct(end.alias("at"), x["value"].alias("last")), F.array(place)

    return scan(pairs, F.struct(F.lit(0).alias("at"), F.lit("").alias("last")), PLACE, step)


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)
        return acc + twice

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _small(part: Column) -> Column:
    """A run of digits that is at most 255."""
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (bare.try_cast("int") <= 255)


def _base(text: Column) -> Column:
    """array<struct<start, end, kind, value, left, right>> of emails, IPs, cards and phones, unordered; null text has none."""
    text = F.coalesce(text, F.lit(""))
    digits = lambda x: F.regexp_replace(x["value"], "[^0-9]", "")
    number = text.rlike("[0-9]")
    # Cheap tests come first: most texts have no match of a kind and skip its patterns.
    wanted = {
        0: (EMAIL, text.contains("@"), None),
        1: (IP, number & text.rlike(r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]"), lambda x: F.forall(F.split(x["value"], r"\."), _small)),
        2: (CARD, number & text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"), lambda x: F.length(digits(x)).between(14, 19) & luhn(digits(x))),
        3: (PHONE, text.contains("+") & number, lambda x: F.length(digits(x)).between(10, 15)),
    }

    def part(kind: int) -> Column:
        pattern, test, good = wanted[kind]
        found = located(text, pattern)
        found = F.filter(found, good) if good else found
        spans = F.transform(found, lambda x: F.struct(x["start"], x["end"], F.lit(kind).alias("kind"), x["value"], x["left"], x["right"]))
        return F.when(test, spans).otherwise(F.array().cast(SPAN.replace("value:string", "value:string,left:string,right:string")))

    return F.concat(*map(part, wanted))


def _bare(spans: Column) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"], x["end"], x["kind"], x["value"]))


def base_spans(text: Column) -> Column:
    """array<struct<start, end, kind, value>> of emails, IPs, cards and phones, unordered; null text has none."""
    return _bare(_base(text))


def context_of(before: Column) -> Column:
    """The last word of a stretch of text, in lower case, with its punctuation; a word without letter or digit takes the one before it along. Empty at a line's start, and where there is no word to take."""
    line = F.substring_index(before, "\n", -1)
    last = F.regexp_extract(line, rf"(?:^|{GAP})({WORD}++){GAP}++$", 1)
    two = F.regexp_replace(F.regexp_extract(line, rf"(?:^|{GAP})({WORD}++{GAP}++{WORD}++){GAP}++$", 1), rf"{GAP}++", " ")
    return F.lower(let(last, lambda w: F.when(w.rlike(r"[\p{L}\p{N}]"), w).otherwise(two)))


def following(after: Column) -> Column:
    """The first word of a stretch of text, in lower case, if white space is before it; empty at a line's end."""
    return F.lower(F.regexp_extract(F.substring_index(after, "\n", 1), rf"^{WORD}*+{GAP}++({WORD}++)", 1))


def shape_of(token: Column, bare: Column) -> Column:
    """Runs of letters as a, of digits as 9 and the lengths of values of both kinds, within the token's outer marks."""
    rough = F.regexp_replace(F.regexp_replace(bare, r"\p{L}++", "a"), r"[0-9]++", "9")
    mixed = F.when(bare.rlike(r"^[0-9a-fA-F]{32,}$"), F.concat(F.lit("hex"), F.length(bare).cast("string"))).otherwise(rough)
    return F.concat_ws(" ", F.regexp_extract(token, r"^[^\p{L}\p{N}@]*+", 0), mixed, F.regexp_extract(token, r"[^\p{L}\p{N}@]*+$", 0))


def named(value: Column) -> Column:
    """What a value or context, in lower case, is counted by: itself, or its hash if it is long."""
    return F.when(F.length(value) > LONG, F.sha2(value, 256)).otherwise(value)


def _apart(found: Column, base: Column) -> Column:
    """The places of found, in order, that overlap none of base."""
    near = F.filter(found, lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    # many of both: sorted together, and scanned from each end for the base span before and after
    kind = "array<struct<start:int,end:int,own:int,at:int>>"
    both = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(0).alias("own"), F.lit(-1).alias("at"))), F.transform(found, lambda x, i: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(1).alias("own"), i.alias("at")))))

    def forwards(state: Column, x: Column) -> tuple[Column, Column]:
        keep = (x["own"] == 0) | (x["start"] >= state)
        return F.when(x["own"] == 0, F.greatest(state, x["end"])).otherwise(state), F.when(keep, F.array(x)).otherwise(F.array().cast(kind))

    def backwards(state: Column, x: Column) -> tuple[Column, Column]:
        keep = (x["own"] == 1) & (x["end"] <= state)
        return F.when(x["own"] == 0, F.least(state, x["start"])).otherwise(state), F.when(keep, F.array(x)).otherwise(F.array().cast(kind))

    clear = lambda: F.reverse(scan(F.reverse(scan(both, F.lit(0), kind, forwards)), F.lit(2**31 - 1), kind, backwards))
    many = F.transform(clear(), lambda x: F.get(found, x["at"]))
    return F.when(F.size(base) == 0, found).when(F.size(found).cast("long") * F.size(base) <= FEW, near).otherwise(many)


def candidates(text: Column, base: Column) -> Column:
    """Identifier-like tokens outside the base spans: at least three digits or an @; with the words before, which may be empty, the word after and the shape."""
    text = F.coalesce(text, F.lit(""))
    pattern = rf"(?<!{WORD})(?={WORD}*[0-9@]){WORD}++"
    found = located(text, pattern)

    def trim(x: Column) -> Column:
        tail = F.regexp_replace(x["value"], r"^[^\p{L}\p{N}@]++", "")
        lead = F.length(x["value"]) - F.length(tail)
        bare = F.regexp_replace(tail, r"(?<![^\p{L}\p{N}@])[^\p{L}\p{N}@]++$", "")
        start = x["start"] + lead
        return F.struct(start.alias("start"), (start + F.length(bare)).alias("end"), bare.alias("value"), x["left"].alias("context"), x["right"].alias("right"), shape_of(x["value"], bare).alias("shape"), bare.rlike(KEY).alias("key"))

    good = lambda x: (F.length(F.regexp_replace(x["value"], "[^0-9]", "")) >= 3) | x["value"].rlike(r"@.*[\p{L}\p{N}]|[\p{L}\p{N}].*@")
    test = text.rlike(rf"@|[0-9]{{3}}|[0-9]{WORD}*[0-9]{WORD}*[0-9]")
    return F.when(test, let(F.filter(F.transform(found, trim), good), lambda f: _apart(f, base))).otherwise(F.array().cast(CANDIDATE))


def features(docs: DataFrame) -> DataFrame:
    """Materialised: uid, doc_id, key (hash of the text), base spans, the seeds' contexts, candidates. Texts are read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    d = d.withColumn("full", _base(F.col("text")))
    seeds = F.transform("full", lambda b: F.struct(b["left"].alias("context"), b["right"].alias("right"), b["value"].alias("value")))
    return cut(d.select("doc_id", F.xxhash64("text").alias("key"), _bare(F.col("full")).alias("base"), seeds.alias("seeds"), candidates(F.col("text"), F.col("full")).alias("found")).withColumn("uid", F.monotonically_increasing_id()))


def _places(docs: DataFrame, useful: DataFrame) -> DataFrame:
    """context, places: how often the useful contexts stand in the corpus: words, and words with a following one without letter or digit."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    # a line's end is a word of its own, which no context goes across
    words = F.filter(F.split(F.replace(text, F.lit("\n"), F.lit(" \n ")), r"[\x20\x09\x0B-\x0D]+"), lambda w: w != "")

    def contexts(ws: Column) -> Column:
        bare = F.filter(F.transform(ws, lambda w, i: F.when(~w.rlike(r"[\p{L}\p{N}]") & (i > 0) & (w != "\n"), F.concat(F.get(ws, i - 1), F.lit(" "), w))), lambda x: x.isNotNull())
        return F.concat(ws, bare)

    each = docs.select(F.explode(let(words, contexts)).alias("context")).select(named(F.col("context")).alias("context"))
    wanted, count = cut(useful), F.count(F.lit(1)).alias("places")
    if wanted.count() * 2 * LONG <= BROADCAST_BYTES:
        return cut(each.join(F.broadcast(wanted), "context", "left_semi").groupBy("context").agg(count))
    return cut(each.groupBy("context").agg(count).join(wanted, "context", "left_semi"))  # words are counted where they stand before any is shuffled


def patterns(docs: DataFrame, table: DataFrame, rounds: int = ROUNDS, confidence: float = LEAST_CONFIDENCE, seeds: int = LEAST_SEEDS) -> tuple[DataFrame, DataFrame]:
    """(family, context, score) of trusted patterns and (value, score) of the instances that they trust, and of base seeds, both materialised.

    Edges pattern-instance are aggregated before any join. Only patterns that can be trusted
    take part: those of enough distinct instances, of which a candidate is one. Instances
    and patterns with very many edges meet their scores by broadcast.
    """
    sides = lambda x, seed, found, more=(): [F.struct(F.lit("left").alias("family"), named(x["context"]).alias("context"), named(F.lower(x["value"])).alias("value"), seed.alias("seed"), F.lit(found).alias("found")), F.struct(F.lit("right").alias("family"), named(x["right"]).alias("context"), named(F.lower(x["value"])).alias("value"), seed.alias("seed"), F.lit(found).alias("found")), *more]
    shape = lambda x: F.struct(F.lit("shape").alias("family"), named(x["shape"]).alias("context"), named(F.lower(x["value"])).alias("value"), F.when(x["key"], 1).otherwise(0).alias("seed"), F.lit(1).alias("found"))
    of = lambda column, make: table.select(F.explode(F.flatten(F.transform(column, make))).alias("e")).select("e.*")
    seeded = of("seeds", lambda x: F.array(*sides(x, F.lit(2), 0)))
    found = of("found", lambda x: F.array(*sides(x, F.when(x["key"], 1).otherwise(0), 1, [shape(x)])))
    every = seeded.unionByName(found).filter("context <> ''").groupBy("family", "context", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"), F.max("found").alias("found"))
    every = cut(every.withColumn("pattern", F.concat(F.substring("family", 1, 1), F.col("context"))))
    base = every.filter("seed = 2").select("value").distinct().withColumn("score", F.lit(1.0))
    able = cut(every.groupBy("pattern").agg(F.count(F.lit(1)).alias("values"), F.max("found").alias("found"), F.first("family").alias("family"), F.first("context").alias("context"), F.sum("n").alias("follow")).filter((F.col("values") >= seeds) & (F.col("found") == 1)))
    if able.isEmpty():  # nothing to discover
        return able.select("family", "context", F.lit(0.0).alias("score")).limit(0), cut(base)
    places = _places(docs, able.filter("family <> 'shape'").select("context").distinct())
    known = cut(able.join(places, "context", "left").select("pattern", "family", "context", F.when(F.col("family") == "shape", None).otherwise(F.coalesce("places", "follow")).alias("places")))
    graph = cut(join_hot(every.select("pattern", "value", "n", "seed"), known.select("pattern", "places", "family"), "pattern"))
    trust = cut(graph.groupBy("value").agg(F.max(F.when(F.col("seed") > 0, 1.0).otherwise(0.0)).alias("trust"), F.max("seed").alias("own")))
    ranked = None
    for _ in range(rounds):
        mass = join_hot(graph, trust.select("value", "trust"), "value").groupBy("pattern").agg(F.sum(F.col("n") * F.col("trust")).alias("mass"), F.sum("n").alias("follow"), F.sum((F.col("trust") >= confidence).cast("int")).alias("support"), F.max("places").alias("places"))
        mass = mass.filter(F.col("mass") >= LEAST_TRUSTED * F.col("follow"))
        share = F.when(F.col("places").isNull(), F.col("mass") / F.col("follow")).otherwise(F.least(F.lit(1.0), F.col("follow") / F.greatest("places", F.lit(1))))
        ranked = cut(mass.select("pattern", (share * (1 - F.pow(F.lit(0.5), F.col("support")))).alias("score"), "support").filter((F.col("score") >= confidence) & (F.col("support") >= seeds)))
        reached = join_hot(graph, ranked.select("pattern", "score"), "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.least(F.col("score"), F.lit(0.999)))))).alias("found"))
        merged = trust.select("value", "own").join(reached, "value", "left")
        trust = cut(merged.select("value", "own", F.coalesce("found", F.lit(0.0)).alias("found"), F.when(F.col("own") > 0, 1.0).otherwise(F.coalesce("found", F.lit(0.0))).alias("trust")))
    good = trust.filter((F.col("found") >= confidence) & (F.col("own") < 2)).select("value", F.col("found").alias("score"))
    return cut(ranked.join(known, "pattern").select("family", "context", "score")), cut(good.unionByName(base))


def discovered(docs: DataFrame, table: DataFrame, **options) -> DataFrame:
    """Materialised: uid, doc_id, key, context spans, for rows that have some."""
    _, trusted = patterns(docs, table, **options)
    each = table.filter(F.size("found") > 0).select("uid", "doc_id", "key", F.explode("found").alias("x")).withColumn("value", named(F.lower("x.value")))
    marks = cut(trusted.select("value"))
    small = marks.count() * 2 * LONG <= BROADCAST_BYTES
    good = each.join(F.broadcast(marks), "value", "left_semi") if small else join_hot(cut(each), marks, "value")
    span = F.struct(F.col("x.start").alias("start"), F.col("x.end").alias("end"), F.lit(4).alias("kind"), F.col("x.value").alias("value"))
    return cut(good.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("key").alias("key"), F.collect_list(span).alias("more")))


def _bytes(spans: str) -> Column:
    """What an array of spans takes, about."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + 48 + F.octet_length(x["value"]))


def written(spans: Column) -> Column:
    """kind:start:end by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"])))
    return F.concat_ws(",", F.transform(ordered, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))))


def find(docs: DataFrame, **options) -> DataFrame:
    """doc_id, base, more of every row: arrays of (start, end, kind, value), more those of the bootstrap.

    Null text is empty. A null or repeated doc_id is carried as it stands, and repeated rows
    count as often as they stand. Texts of any length are read whole. Other columns are
    ignored. An empty table gives none.
    """
    table = features(docs)
    more = discovered(docs, table, **options)
    out = join_checked(table.select("uid", "doc_id", "base"), more.select("uid", "more"), ["uid"], "left", 64, _bytes("more"))
    return out.select("doc_id", "base", F.coalesce("more", F.array().cast(SPAN)).alias("more"))


def masked(text: Column, spans: Column) -> Column:
    """text with each span replaced by its kind in brackets; of overlapping spans the first, then the longest, then the first kind counts."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"], (-x["end"]).alias("last"), x["kind"], x["end"])))

    def body(take) -> Column:
        def step(state: Column, x: Column) -> tuple[Column, Column]:
            good = x["start"] >= state
            put = F.array(F.struct(state.alias("a"), x["start"].alias("b"), F.get(names, x["kind"]).alias("name"), x["end"].alias("end")))
            return F.when(good, x["end"]).otherwise(state), F.when(good, put).otherwise(F.array().cast(kind))

        kind = "array<struct<a:int,b:int,name:string,end:int>>"
        kept = scan(ordered, F.lit(0), kind, step)
        rest = lambda ks: take(F.coalesce(F.get(ks, F.size(ks) - 1)["end"], F.lit(0)), F.length(text))
        return let(kept, lambda ks: F.concat(F.array_join(F.transform(ks, lambda x: F.concat(take(x["a"], x["b"]), x["name"])), ""), rest(ks)))

    return cutter(text, body)


def redact(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs with personal data in text replaced by its kind, and n_chars, if there, counted anew where text changed.

    Null text stays null. Spans of the bootstrap are brought to their rows by doc_id, null
    like any other, and the text's hash, so repeated rows are all redacted. Columns of any
    name pass through. Texts of any length are read whole. An empty table gives none.
    """
    table = features(docs)
    found = discovered(docs, table, **options)
    places = F.transform("more", lambda x: F.struct(x["start"], x["end"], x["kind"], F.lit("").alias("value")))
    more = cut(found.select(F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), F.col("key")).alias("at"), places.alias("more")).groupBy("at").agg(F.first("more").alias("more")))
    identity = F.col("doc_id").cast("long")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.struct(identity.isNull(), F.coalesce(identity, F.lit(0)), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))).alias("at"))
    joined = whole.withColumn("more", F.array().cast(SPAN)) if more.isEmpty() else join_checked(whole, more, ["at"], "left", 64, _bytes("more"))
    text = F.col("row.text").cast("string")
    out = joined.select("row", F.concat(base_spans(text), F.coalesce("more", F.array().cast(SPAN))).alias("spans"))
    changed = F.size("spans") > 0
    new = F.when(changed, masked(text, F.col("spans"))).otherwise(text)
    out = out.select("row", changed.alias("changed"), new.alias("new"))
    values = {"text": F.col("new").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(F.col("changed"), F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return out.select(*[values.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
