"""Each operator against a plain version, an exact round trip or held-out accuracy, and on odd tables."""

import hashlib
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgraph.llm import decontam, langid, pieces, pii, quality, resample, shared, simhash, tokenfiles, warc
from loomgraph.llm.components import components
from loomgraph.llm.shared import scratch

SF = "/root/testdata/sf0.001"
ODD = [(1, "a b c d e f g"), (2, None), (3, ""), (None, "a b c d e f g"), (1, "a b c d e f g"), (4, "word " * 30_000), (5, "\n \t\x0b"), (6, "mail x@y.zz or 1.2.3.4")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, long, repeated; columns that clash with results."""
    rows = [(i, t, None, "f", 0, "s", 1.5) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, fp string, score int, kept string, n_tokens double")


def empty(df):
    return df.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1
PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(s):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if i % 2 else int(c) for i, c in enumerate(reversed(s))) % 10 == 0


def plain_spans(text):
    out = []
    for k, (name, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": name != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]
            out += [(m.start(), k, m.end())] * good
    return ",".join(f"{list(PATTERNS)[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_pii_base(spark, docs, odd):
    cases = ["a@b.c%x@d.e", "a@b.c.-x..y@d.e @ q@-.- x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255", "4041 8949-7460 8795x4041894974608795", "é😀 +1 (988) 555-2485 +12345678901234567", "9" * 20_000, "a." * 9_000 + "@b.c"]
    table = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string").union(docs.select("doc_id", "text")).union(odd.select("doc_id", "text"))
    for r in table.select("text", pii.written(pii.base_spans(table.text)).alias("s")).collect():
        assert r.s == plain_spans(r.text)


def test_pii_contexts(spark, docs, odd):
    rows = [(100 + i, f"hello staff-id: emp{i:03d}{i * 7:04d} and e{i}") for i in range(20)] + [(200 + i, f"x staff-id: foo{i}@bar.example.com") for i in range(6)] + [(300, "other text emp0010007 here")]
    table = spark.createDataFrame(rows, "doc_id long, text string").union(docs.select("doc_id", "text"))
    found = {r.doc_id: r.more for r in pii.find(table).collect() if r.more}
    assert set(found) == {*range(100, 120), 300}
    assert [(s.start, s.end) for s in found[300]] == [(11, 21)]
    kept = pii.redact(odd)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    assert kept.filter("doc_id = 6").first().text == "mail [EMAIL] or [IP]"
    assert pii.find(empty(odd)).count() == 0


def test_pii_wherever_they_stand(spark):
    """Trusted instances after another token with digits, at a line's start and at the text's start."""
    rows = [(100 + i, f"hello staff-id: emp{i:03d}{i * 7:04d} there") for i in range(20)] + [(200 + i, f"x staff-id: foo{i}@bar.example.com") for i in range(6)]
    rows += [(300, "emp0010007 first"), (301, "line\nemp0010007"), (302, "7536 emp0010007"), (303, "v2: 5555 (emp0010007), x")]
    found = {r.doc_id: r.more for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.more}
    assert {i: [(s.start, s.end) for s in found.get(i, [])] for i in range(300, 304)} == {300: [(0, 10)], 301: [(5, 15)], 302: [(5, 15)], 303: [(10, 20)]}
    contexts = spark.createDataFrame([("id2: emp0017\n123 a 456",)], "text string").select(pii.candidates(F.col("text"), F.array().cast(pii.SPAN)).alias("c")).first().c
    assert [(c.value, c.context) for c in contexts] == [("emp0017", "id2:"), ("123", ""), ("456", "a")]


def test_pii_addresses_and_long_values(spark):
    """Handles and addresses without digits, values and contexts of any length."""
    key, label = "ab12" * 32, "k" * 100 + ":"
    rows = [(i, f"hello host-user: name{'abcdefgh'[i]}@intranet there") for i in range(8)] + [(10 + i, f"by host-user: foo{i}@bar.example.com") for i in range(6)]
    rows += [(20, "so @alice, x"), (21, f"host-user: @alice x {key}"), (22, f"host-user: {key}"), (23, "a @ b")]
    rows += [(30 + i, f"w {label} foo{i}@bar.example.com") for i in range(6)] + [(40, f"{label} 1234567"), (41, "q 1234567")]
    found = {r.doc_id: [(s.start, s.end) for s in r.more] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.more}
    assert found == {**{i: [(17, 31)] for i in range(8)}, 20: [(3, 9)], 21: [(11, 17), (20, 148)], 22: [(11, 139)], 40: [(102, 109)], 41: [(2, 9)]}


def plain_bootstrap(texts):
    """Context spans in plain Python: texts to a list of (text, start, end)."""
    gap, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    lettered = lambda w: any(c.isalnum() for c in w)
    hexed = lambda v: bool(re.fullmatch(r"[0-9a-fA-F]{32,}", v))
    key = lambda v: hexed(v) and v.lower() != v.upper() and any(c.isdigit() for c in v)

    def left(before):
        ws = re.split(f"{gap}+", before.split("\n")[-1])
        if ws[-1] != "" or len(ws) < 2 or not ws[-2]:
            return ""
        w = ws[-2]
        return (w if lettered(w) else f"{ws[-3]} {w}" if len(ws) > 2 and ws[-3] else "").lower()

    def right(after):
        m = re.match(rf"{word}*{gap}+({word}+)", after.split("\n")[0])
        return m[1].lower() if m else ""

    def places(found):
        """(start, end, left, right) of matches in order: contexts reach to the neighbour matches."""
        out = []
        for k, (a, b) in enumerate(found):
            out.append((a, b, found[k - 1][0] if k else 0, found[k + 1][0] if k + 1 < len(found) else None))
        return out

    edges, spots = Counter(), []
    words, seed = Counter(), {}
    for i, t in enumerate(texts):
        base = []
        for name, p in PATTERNS.items():
            matches = [m.span() for m in re.finditer(p, t)]
            kept = {(int(a), int(b)) for k, a, b in (s.split(":") for s in plain_spans(t).split(",") if s) if k == name}
            for a, b, lo, hi in places(matches):
                if (a, b) in kept:
                    base.append((a, b))
                    v = t[a:b].lower()
                    seed[v] = 2
                    edges["l", left(t[lo:a]), v, 0] += 1
                    edges["r", right(t[b:hi]), v, 0] += 1
        tokens = [m.span() for m in re.finditer(rf"{word}+", t) if re.search("[0-9@]", m[0])]
        for a, b, lo, hi in places(tokens):
            token = t[a:b]
            tail = re.sub(r"^[\W_]+", "", token.replace("@", "a"))
            lead = len(token) - len(tail)
            bare = token[lead : lead + len(re.sub(r"[\W_]+$", "", tail))]
            x, y = a + lead, a + lead + len(bare)
            if (sum(c.isdigit() for c in bare) < 3 and not ("@" in bare and lettered(bare))) or any(c < y and x < d for c, d in base):
                continue
            v = bare.lower()
            seed[v] = max(seed.get(v, 0), int(key(bare)))
            spots.append((i, x, y, v))
            rough = f"hex{len(bare)}" if hexed(bare) else re.sub("[0-9]+", "9", re.sub(r"[^\W\d_]+", "a", bare))
            edges["l", left(t[lo:a]), v, 1] += 1
            edges["r", right(t[b:hi]), v, 1] += 1
            edges["s", f"{token[:lead]} {rough} {token[lead + len(bare):]}", v, 1] += 1
        for line in t.lower().split("\n"):
            ws = [w for w in re.split(f"{gap}+", line) if w]
            words.update(ws)
            words.update(f"{p} {w}" for p, w in zip(ws, ws[1:], strict=False) if not lettered(w))
    graph, able = {}, {}
    for (family, c, v, found), n in edges.items():
        if c:
            own = graph.setdefault((family, c), Counter())
            own[v] += n
            able[family, c] = able.get((family, c), 0) or found
    graph = {p: own for p, own in graph.items() if len(own) >= pii.LEAST_SEEDS and able[p]}
    trust = {v: float(seed[v] > 0) for own in graph.values() for v in own}
    found = {}
    for _ in range(pii.ROUNDS):
        score = {}
        for (family, c), own in graph.items():
            mass, follow = sum(n * trust[v] for v, n in own.items()), sum(own.values())
            support = sum(trust[v] >= pii.LEAST_CONFIDENCE for v in own)
            share = mass / follow if family == "s" else min(1.0, follow / max(1, words.get(c, follow)))
            s = share * (1 - 0.5**support)
            if mass >= pii.LEAST_TRUSTED * follow and s >= pii.LEAST_CONFIDENCE and support >= pii.LEAST_SEEDS:
                score[family, c] = s
        found = {v: 1 - np.prod([1 - min(s, 0.999) for p, s in score.items() if v in graph[p]]) for v in trust}
        trust = {v: 1.0 if seed[v] else found[v] for v in trust}
    good = {v for v, f in found.items() if f >= pii.LEAST_CONFIDENCE} | {v for v, k in seed.items() if k == 2}
    return sorted((i, a, b) for i, a, b, v in spots if v in good)


def test_pii_bootstrap_is_that_of_plain_python(spark, docs, monkeypatch):
    rng = np.random.default_rng(12)
    keys = ["".join(rng.choice(list("0123456789abcdef"), 40)) for _ in range(8)]
    texts = [r.text or "" for r in docs.limit(80).collect()]
    texts += [f"le token = \"{k}\" a b\n und token = \"x{i}y{i}77{i}\" fin" for i, k in enumerate(keys)]
    texts += [f"{keys[0]} alone", "| 1.2.3.4 | 555123 |", "by host: a1@b.cc, by host: zz99887 or"] + [f"by host: u{i}@mail.org to you" for i in range(5)]
    texts += ["(7001) at home", "the token = it", "\n = 12345\n\n 9 token =\n777777"] + [f"nr 55{i} von emp-100{i}" for i in range(4)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_bootstrap(texts)
    assert len(want) >= 17
    for most in (pii.BROADCAST_BYTES, 0):  # with and without broadcasts
        monkeypatch.setattr(pii, "BROADCAST_BYTES", most)
        assert sorted((r.doc_id, s.start, s.end) for r in pii.find(table).collect() for s in r.more) == want
    assert {(88 - 8 + i) for i in range(8)} <= {i for i, _, _ in want}


def test_pii_of_very_many_tokens(spark):
    """Spans and redaction of a text with tens of thousands of matches of each sort, in order and in linear passes."""
    text = "id 12345 a@b.cd x 1.2.3.4 " * 20_000
    table = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = pii.find(table).first()
    assert len(row.base) == 40_000
    assert [(s.start, s.end) for s in sorted(row.base)[-2:]] == [(len(text) - 26 + 9, len(text) - 26 + 15), (len(text) - 26 + 18, len(text) - 26 + 25)]
    assert pii.redact(table).first().text == "id 12345 [EMAIL] x [IP] " * 20_000


def test_pii_columns_that_clash(spark):
    table = spark.createDataFrame([(1, "a@b.cd", 7, "k", "s", "m")], "doc_id long, text string, __id long, __key string, spans string, more string")
    assert tuple(pii.redact(table).first()) == (1, "[EMAIL]", 7, "k", "s", "m")


# 2
def test_language(spark, docs, odd):
    texts = langid.training(docs)
    rows = langid.predict(docs.select("doc_id", "text"), texts).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2 and r.lang_pred != "und"]
    assert len(held) > 20 and np.mean([r.lang == r.lang_pred for r in held]) > 0.93
    got = langid.predict(odd, texts).collect()
    assert len(got) == len(ODD) and [r.lang_pred for r in got if r.doc_id in (2, 3, 5)] == ["und"] * 3
    assert langid.keep_identified(odd, texts).columns == odd.columns
    assert langid.training(odd) == {} and langid.predict(odd, {}).filter("lang_pred <> 'und'").count() == 0


def test_cross_parsing():
    text, probe = "the cat sat on the mat and the cat ran", "the cat and the mats on catmat"
    seq, x = langid.letters(text), langid.letters(probe)
    ids = np.full(0x110000, 30, np.uint16)
    known = np.unique(seq)
    ids[known] = np.arange(len(known))
    a = langid.Automaton(ids[seq].tolist(), 31)
    lane = ids[x][:, None]
    hay, phrases, at = "".join(map(chr, seq)), 0, 0
    needle = "".join(map(chr, x))
    while at < len(needle):
        n = 1
        while at + n < len(needle) and needle[at : at + n + 1] in hay:
            n += 1
        at, phrases = at + n, phrases + 1
    assert a.phrases(lane, np.array([len(x)]))[0] == phrases


def plain_phrases(hay, needle):
    """Longest matches, one after the other; an unseen letter is a phrase of its own."""
    at, phrases = 0, 0
    while at < len(needle):
        n = 1
        while at + n < len(needle) and needle[at : at + n + 1] in hay:
            n += 1
        at, phrases = at + n, phrases + 1
    return phrases


def test_predictions_are_those_of_plain_parsing(spark, docs):
    """Language, score and told of whole texts, from substring search in the training texts."""
    texts = langid.training(docs)
    own = [r.text for r in docs.filter("length(text) < 3000").limit(60).collect()]
    rng = np.random.default_rng(4)
    own += ["ж" * 300, "a", "1 2 3", "", "qq", "".join(map(chr, rng.integers(0x4E00, 0x5000, 200)))]
    flat = lambda t: "".join(map(chr, langid.letters(t)))
    hays = {k: flat(t) for k, t in sorted(texts.items())}
    for text, name, score, told in zip(own, *langid.Model(texts).predict(own), strict=True):
        needle = flat(text)
        if not needle.strip("\0"):
            assert (name, score, told) == ("und", 0.0, False)
            continue
        phrases = {k: sum(plain_phrases(h, needle[c : c + langid.CHUNK]) for c in range(0, len(needle), langid.CHUNK)) for k, h in hays.items()}
        cost = {k: n * np.log2(len(hays[k])) for k, n in phrases.items()}
        best, second = sorted(cost, key=lambda k: (cost[k], k))[:2]
        assert name == best and score == pytest.approx(cost[second] / (cost[best] + cost[second]))
        assert told == ((phrases[best] - 1) * np.log2(len(hays[best])) < len(needle) * np.log2(len(set(hays[best]))))


def test_training_takes_whole_texts(spark):
    rows = [(i, f"kurz {i} " + "wort " * (i % 7), "de") for i in range(0, 400)] + [(5000 + i, "long " * 9000, "en") for i in range(3)] + [(7000, "mot " * 9000, "fr"), (7000, "mot " * 9000, "fr"), (7002, "les mots", "fr")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    by_text = {(k, t): i for i, t, k in rows}
    texts = langid.training(table)
    for lang, joined in texts.items():
        parts = joined.split("\n")
        assert all((lang, p) in by_text and zlib.crc32(str(by_text[lang, p]).encode()) % 4 != 2 for p in parts)
        assert len(parts) == 1 or len(joined) <= langid.TRAIN_CHARS + len(parts)
    assert len(texts["de"].split("\n")) == langid.TRAIN_ROWS and texts["en"] == "long " * 9000


def test_rejected_languages(spark, odd, docs):
    texts = langid.training(docs)
    rng = np.random.default_rng(6)
    rows = [(1, "".join(map(chr, rng.integers(0x4E00, 0x5000, 300)))), (2, "the"), (3, None), (4, "42"), (4, "42"), (None, "und der die das ist"), (6, "жщ" * 200)]
    kept = langid.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), texts).collect()
    assert sorted(str(r.doc_id) for r in kept) == ["2", "None"]
    assert langid.keep_identified(odd, {}).count() == 0 and langid.keep_identified(empty(odd), texts).count() == 0
    assert langid.predict(empty(odd), texts).count() == 0 and langid.training(empty(odd)) == {}


def test_languages_of_many_letters():
    """Each training letter is its own symbol, whatever other languages there are; phrases as plain Python finds them."""
    rng = np.random.default_rng(2)
    starts = {"zh": (0x4E00, 3000), "zh2": (0x4E00, 3000), "ko": (0xAC00, 2000), "en": (0x61, 26), "ru": (0x430, 32), "ka": (0x10D0, 33), "am": (0x1200, 70), "ii": (0xA000, 400)}
    texts = {}
    for lang, (first, n) in starts.items():
        vocabulary = ["".join(chr(first + k) for k in rng.integers(0, n, 2 + len(lang))) for _ in range(900)]
        texts[lang] = [" ".join(rng.choice(vocabulary, m)) for m in (4000, 60, 60)]
    model = langid.Model({k: t[0][: langid.TRAIN_CHARS] for k, t in texts.items()})
    assert model.predict([t for k in model.langs for t in texts[k][1:]])[0] == [k for k in model.langs for _ in range(2)]
    for lang, probe in (("zh", "zh"), ("zh", "zh2"), ("zh2", "zh"), ("ko", "ko"), ("ii", "ii"), ("en", "en")):
        hay = "".join(map(chr, langid.letters(texts[lang][0][: langid.TRAIN_CHARS])))
        x = np.array([c for c in langid.letters(texts[probe][1]) if chr(c) in hay])
        assert len(x) > 50
        needle, at, phrases = "".join(map(chr, x)), 0, 0
        while at < len(needle):
            n = 1
            while at + n < len(needle) and needle[at : at + n + 1] in hay:
                n += 1
            at, phrases = at + n, phrases + 1
        assert model.automata[model.langs.index(lang)].phrases(model.ids[x][:, None], np.array([len(x)]))[0] == phrases


# 3
def test_decontamination(spark, docs, odd):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.filter("item_id = 3").first().text.split()
    edited = ["zz" if i % 9 == 4 else w for i, w in enumerate(item)]
    more = spark.createDataFrame([(9001, "before " + " ".join(edited) + " after"), (9002, " ".join(item[:5])), (9003, "x y z " + " ".join(item) + " x")], "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontam.contaminated(docs.select("doc_id", "text").union(more), bench).collect()}
    assert found[9003, 3].score == 1.0 and (found[9003, 3].first_word, found[9003, 3].end_word) == (3, 3 + len(item))
    assert 0.5 < found[9001, 3].score < 1 and not any(d == 9002 for d, _ in found)
    norm = lambda t: b" ".join(decontam.words(t))
    items = {r.item_id: norm(r.text) for r in bench.collect()}
    exact = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if b" " + t + b" " in b" " + norm(r.text) + b" "}
    assert exact <= set(found)
    assert decontam.contaminated(odd, bench).count() == 0
    assert decontam.contaminated(docs, empty(bench)).count() == 0
    assert {r.doc_id for r in decontam.keep_clean(docs, bench).collect()} == {r.doc_id for r in docs.collect()} - {d for d, _ in found}
    short = spark.createDataFrame([(1, "Mail"), (2, None), (None, "x"), (3, "a b")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.contaminated(odd, short).collect()} == {(6, 1), (1, 3), (None, 3)}


def test_seeds_miss_no_alignment(spark, docs, monkeypatch):
    """Spread insertions, drops and replacements, and texts of few words, against alignment of whole texts."""
    rng = np.random.default_rng(5)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text.lower().split() for r in bench.collect()}
    edits = [
        lambda w: [y for i, x in enumerate(w) for y in ((x, "zz") if i % 2 else (x,))],
        lambda w: [y for x in w for y in (x, "zz")],
        lambda w: ["zz" if i % 3 == 2 else x for i, x in enumerate(w)],
        lambda w: [x for i, x in enumerate(w) if i % 3 != 2],
        lambda w: [y for x in w for y in ((x, "zz"), ("zz",), (), (x,), (x,), (x,))[rng.integers(6)]],
    ]
    rows = [(10_000 + 100 * i + k, " ".join(["before", *edit(w), "after"] * (1 + k % 2))) for i, w in items.items() for k, edit in enumerate(edits)]
    few = {1000 + i: [f"w{x}" for x in rng.integers(0, 5, rng.integers(1, 12))] for i in range(40)}
    rows += [(100_000 + i, " ".join(f"w{x}" for x in rng.integers(0, 8, 60))) for i in range(40)]
    table = docs.select("doc_id", "text").limit(50).union(spark.createDataFrame(rows, "doc_id long, text string"))
    both = bench.select("item_id", "text").union(spark.createDataFrame([(i, " ".join(w)) for i, w in few.items()], "item_id long, text string"))
    texts = {r.doc_id: decontam.words(r.text) for r in table.collect()}
    want = {}
    for r in both.collect():
        item = decontam.words(r.text)
        known = {w: k for k, w in enumerate(dict.fromkeys(item))}
        for d, own in texts.items():
            if (d < 100_000 or r.item_id >= 1000) and 2 * sum(w in set(own) for w in item) >= len(item):
                score = decontam.smith_waterman(np.array([known[w] for w in item]), np.array([known.get(w, -1) for w in own]))[0] / 2 / len(item)
                if score >= 0.5:
                    want[d, r.item_id] = score
    assert {(r.doc_id, r.item_id): r.score for r in decontam.contaminated(table, both).collect()} == want
    assert sum(d == 10_000 + 100 * i + k for d, i in want for k in range(4) if i < 1000) == 4 * len(items)
    monkeypatch.setattr(decontam, "blocks", lambda _: ([(r.item_id, r.text) for r in both.collect()[k::3]] for k in range(3)))
    assert sorted(r.doc_id for r in decontam.keep_clean(table, both).collect()) == sorted(set(texts) - {d for d, _ in want})


def test_clean_rows_without_a_broadcast(spark, docs, odd, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    table = docs.select("doc_id", "text", F.lit("r").alias("row"), F.lit(1).alias("h1"), F.lit("s").alias("salt"))
    table = table.union(table).union(odd.select("doc_id", "text", F.lit("r"), F.lit(1), F.lit("s")))
    want = sorted(map(repr, decontam.keep_clean(table, bench).collect()))
    held = {r.doc_id for r in decontam.contaminated(docs, bench).collect()}
    assert len(want) == 2 * (docs.count() - len(held)) + len(ODD) and held
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    assert sorted(map(repr, decontam.keep_clean(table, bench).collect())) == want


def test_blocks_are_fitted_on_all_rows(spark, docs, monkeypatch):
    rows, fit = [], decontam.fit
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    monkeypatch.setattr(decontam, "blocks", lambda _: iter([items[:20], items[20:]]))
    monkeypatch.setattr(decontam, "fit", lambda d, *more: rows.append(d.count()) or fit(d, *more))
    left = decontam.keep_clean(docs, None).count()
    assert rows == [docs.count()] * 2 and left < docs.count()


def test_smith_waterman():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 4, 6), rng.integers(0, 4, 9)
        h = np.zeros((7, 10), int)
        for i in range(6):
            for j in range(9):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontam.smith_waterman(a, b)[0] == h.max()


# 4
def test_quality(spark, docs, odd):
    table = docs.select("doc_id", "text").union(odd.select("doc_id", "text").filter("doc_id is not null and doc_id <> 1")).union(spark.createDataFrame([(-1, "a b c d e a b c d e a b c d e f"), (-2, "a\na\n \n\nb\na")], "doc_id long, text string"))
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    n = 0
    for r in quality.judge(table).collect():
        if r.doc_id in (4, 1, 2, 3, 5, 6):
            continue  # ids that both tables have
        n += 1
        t = texts[r.doc_id]
        w = words(t)
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        c = Counter(grams)
        repeat = len({j for i, g in enumerate(grams) if c[g] > 1 for j in range(i, i + 5)})
        lines = [x for x in t.split("\n") if words(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(x in quality.MARKS for x in t), len(lines) - len(set(lines)), repeat)
        assert r.base_failed == (len(w) < 10 or 100 * repeat > 20 * len(w)) and not (r.base_failed and r.kept)
    assert n > 150 and quality.judge(odd).count() == len(ODD) and quality.judge(empty(odd)).count() == 0
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    both = quality.judge(docs).filter("not base_failed").join(labels, "doc_id").collect()
    assert np.mean([r.kept for r in both if r[-2] == 1]) > 0.95 and np.mean([r.kept for r in both if r[-2] == 0]) < 0.5


def plain_em(patterns, kinds, rounds):
    """patterns: votes to counts; EM in numpy."""
    v, n = np.array(list(patterns)), np.array(list(patterns.values()), float)
    start = quality.Fit(kinds)
    share, bad = np.array(start.share), np.array(start.bad)

    def answer():
        logs = np.log(share) + (v < 0) @ np.log(bad).T + (v > 0) @ np.log(1 - bad).T
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    for _ in range(rounds):
        mass = n[:, None] * answer()
        old, share = share, (mass.sum(0) + 1) / (n.sum() + len(share))
        bad = (mass.T @ (v < 0) + 1) / (mass.T @ (v != 0) + 2)
        if abs(old - share).max() < 1e-4:
            break
    return share, bad, dict(zip(patterns, answer()[:, 0], strict=True))


def test_em_of_whole_tables(spark, docs):
    """Shares, accuracies and posteriors are those of EM in numpy over the same votes."""
    ballots = quality.rules()
    names, kinds = list(ballots), [k for k, _ in ballots.values()]
    voted = quality.measures(docs).select("doc_id", *[v.alias(f"v_{n}") for n, (_, v) in ballots.items()]).collect()
    votes = {r.doc_id: tuple(r[f"v_{n}"] for n in names) for r in voted}
    _, _, want = plain_em(Counter(votes.values()), kinds, quality.ROUNDS)
    for r in quality.judge(docs).collect():
        assert r.quality == pytest.approx(want[votes[r.doc_id]], abs=1e-6)
        assert r.kept == (not r.base_failed and r.quality >= 0.5)


def test_em_outvotes_a_rule_that_fails_good_text(spark):
    """Of two rules that call a tenth bad together and a third that calls a fifth bad at random: its votes alone are overruled, though not every rule is passed."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(2000):
        junk = i % 10 == 0
        a, b = (-1 if rng.random() < (0.9 if junk else 0.01) else 1 for _ in range(2))
        rows.append((a, b, -1 if rng.random() < 0.2 else 1 if i % 3 else 0))
    table = spark.createDataFrame(rows, "v_a int, v_b int, v_c int")
    kinds = {"a": 1, "b": 1, "c": 1}
    got = quality.fit(table, kinds)
    share, bad, want = plain_em(Counter(rows), [1, 1, 1], quality.ROUNDS)
    assert got.share == pytest.approx(list(share), abs=1e-6) and np.allclose(got.bad, bad, atol=1e-6)
    assert 0.87 < got.share[0] < 0.93 and got.bad[0][2] == pytest.approx(0.2 / (0.2 + 0.8 * 2 / 3), abs=0.03) and got.bad[1][0] > 0.8
    p = {(r.v_a, r.v_b, r.v_c): r.p for r in table.distinct().withColumn("p", got.posterior([F.col(f"v_{k}") for k in kinds])).collect()}
    assert p == pytest.approx(want, abs=1e-6)
    assert p[1, 1, -1] > 0.9 and p[-1, -1, 1] < 0.1
    assert quality.fit(table.limit(0), kinds).share == [0.5, 0.5]


def test_measures_in_sql(spark, docs):
    import duckdb

    from loomgraph.llm.queries import ORACLES, QUERIES

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = QUERIES["quality_measures"](spark, SF)
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['quality_measures']})").fetchall())


# 5 and 10
def test_token_files(spark, docs, odd):
    t = tokenfiles.Tokenizer(pieces.model_path(tokenfiles.VOCABULARY))
    texts = [r.text for r in docs.collect()] + ["", "a  b", " x", "x ", "a \n b", "a\n b\tc", "don't  ", "é 漢字 12 3"]
    assert all(t.encode(x) == t.plain(x) for x in texts)
    want = Counter((r.doc_id, len(t.plain(r.text)) // 2 if r.text else 0) for r in docs.union(docs).select("doc_id", "text").union(odd.select("doc_id", "text")).collect())
    both = docs.select("doc_id", "text").union(docs.select("doc_id", "text")).union(odd.select("doc_id", "text")).coalesce(2)
    for size in (16, 4096):  # documents that end in other blocks than they begin, and blocks without an end
        assert Counter(map(tuple, tokenfiles.token_counts(both if size > 16 else odd, size=size).collect())) == (want if size > 16 else Counter((i, len(t.plain(x)) // 2 if x else 0) for i, x in ODD))
    assert tokenfiles.token_counts(empty(odd)).count() == 0


def test_more_rows_than_a_batch(spark):
    n = 25_000
    table = spark.range(n, numPartitions=2).selectExpr("id AS doc_id", "concat('w', id) AS text")
    assert tokenfiles.token_counts(table).filter("n_tokens > 0").count() == n
    pages = spark.range(n, numPartitions=1).selectExpr("id AS page_id", "'u' AS url", "concat('p', id) AS html")
    assert warc.round_trip(pages).count() == n


def test_training_order(spark, docs):
    for n in (1, 2, 3, 17, 1000):
        p = tokenfiles.Permutation(n, 5)
        slots = p.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (p.sequences(slots) == np.arange(n)).all()
    folder = scratch(spark, "order-test")
    rows = tokenfiles.materialise(docs.coalesce(3), folder, length=64, per_shard=100, key=9).collect()
    stream = b"".join(tokenfiles.open_input(u).read() for u, _ in tokenfiles.listing(f"{folder}/flat"))
    stream = np.frombuffer(stream, "<u2")
    assert sorted(r.slot for r in rows) == list(range(-(-len(stream) // 64)))
    for r, x in zip(sorted(rows, key=lambda r: r.slot), tokenfiles.read_slots(folder, 0, len(rows), 64, 100), strict=True):
        own = stream[r.sequence * 64 : r.sequence * 64 + 64]
        assert r.n_tokens == len(own) and (x[: len(own)] == own).all() and hashlib.sha1(x.tobytes()).hexdigest() == r.sha1


def test_training_order_in_any_number_of_waves(spark, odd):
    """Equal shards whatever the waves; null, empty, repeated and very long texts; sequences over several files."""
    want = None
    for waves in (1, 3):
        folder = scratch(spark, "waves")
        rows = tokenfiles.materialise(odd.repartition(3, "doc_id"), folder, length=128, per_shard=32, key=4, waves=waves).collect()
        got = [(r.slot, r.shard, r.byte_offset, r.n_tokens) for r in sorted(rows, key=lambda r: r.slot)]
        shards = [tokenfiles.open_input(u).read() for u, _ in tokenfiles.listing(f"{folder}/shards")]
        assert got == [(k, k // 32, k % 32 * 256, got[k][3]) for k in range(len(rows))] and sum(map(len, shards)) == 256 * len(rows)
        assert sum(r.n_tokens for r in rows) == sum(n // 2 for _, n in tokenfiles.listing(f"{folder}/flat"))
        want = want or (got, [r.sha1 for r in sorted(rows, key=lambda r: r.slot)])
        assert want == (got, [r.sha1 for r in sorted(rows, key=lambda r: r.slot)])
    assert tokenfiles.materialise(empty(odd), scratch(spark, "waves")).count() == 0


# 6
def test_pieces(spark, docs, odd):
    import sentencepiece

    path = pieces.model_path()
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.load(path)
    texts = [r.text for r in docs.collect()] + ["  a  b ", "aaaaaaaaaaaa", "   ", "x\n\n  y\tz", "日本語 😀 text", "ｆ ﬁ ²", "thethe" * 30, "!!!!----====", "\n", "a\n", "▁ x"]
    for t in texts:
        assert model.encode(t).tolist() == library.encode(t)
        assert "▁" in t or model.decode(model.encode(t)) == t
    got = {r.doc_id: r for r in pieces.encode(odd, path).collect()}
    assert got[2].n_tokens == 0 and got[4].n_tokens == len(library.encode("word " * 30_000)) and all(r.round_trip for r in got.values())
    assert {r.doc_id: r.text for r in pieces.decode(pieces.encode(docs, path), path).collect()} == {r.doc_id: r.text for r in docs.collect()}


def test_viterbi():
    model = pieces.Model(open(pieces.model_path(), "rb").read(), pieces.UNIGRAM)
    names = {}
    for end, (i, n) in model.automaton.iter("▁hand▁and"):
        names["▁hand▁and"[end + 1 - n : end + 1]] = i
    best = {0: (0.0, [])}
    text = "▁hand▁and"
    for e in range(1, len(text) + 1):
        best[e] = max((best[s][0] + model.score[names[text[s:e]]], [*best[s][1], names[text[s:e]]]) for s in range(e) if text[s:e] in names)
    assert model._viterbi(text) == best[len(text)][1]


def test_unigram_model_over_whole_texts(spark, docs, odd):
    """Read as a unigram model, the pieces of every whole text have the best sum of scores that search over all pieces finds."""
    path = pieces.model_path()
    model = pieces.load(path, pieces.UNIGRAM)
    by_name = {}
    for i in range(len(model.score)):
        if model.decoded[i] and i not in model.of_byte and i != model.unknown:
            by_name[model.decoded[i].replace(" ", "▁")] = model.score[i]
    longest = max(map(len, by_name))
    texts = {r.doc_id: r.text or "" for r in docs.filter("length(text) < 1500").limit(40).union(odd.filter("doc_id in (2, 3, 5, 6)").select(docs.columns[0], "text", *[F.lit(None).cast(t).alias(c) for c, t in docs.dtypes[2:]])).collect()}
    table = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in pieces.encode(table, path, pieces.UNIGRAM).collect()}
    for i, t in texts.items():
        line = ("▁" + t.replace(" ", "▁")) if t else ""
        best = [0.0] + [-1e18] * len(line)
        for e in range(1, len(line) + 1):
            best[e] = best[e - 1] + model.least if line[e - 1] not in by_name else -1e18
            for s in range(max(0, e - longest), e):
                p = by_name.get(line[s:e])
                if p is not None:
                    best[e] = max(best[e], best[s] + p)
        score, run = 0.0, b""
        for k in got[i].token_ids:
            if k in model.of_byte:
                run += bytes([model.of_byte[k]])
            else:
                score += model.score[k]
        score += model.least * len(run.decode("utf-8"))
        assert score == pytest.approx(best[-1], abs=1e-6) and got[i].round_trip and got[i].n_tokens == len(got[i].token_ids)
    assert pieces.encode(empty(odd), path).count() == 0


# 7
def test_warc(spark):
    rows = [(5, "http://a/ b", "x" * 50_000), (3, None, "x" * 50_000), (9, "u", None), (2, "u", ""), (7, "u", "é\r\n\r\n0\r\n"), (7, "u", "é\r\n\r\n0\r\n"), (None, "u", "é\r\n\r\n0\r\n"), (11, "u", "WARC/1.1\r\n" * 9000)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = sorted((str(i), len((h or "").encode()), warc.digest32((h or "").encode()), "response" if first[h or ""] == i else "revisit", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    assert sorted((str(r[0]), *r[1:]) for r in warc.round_trip(pages).collect()) == want
    assert warc.round_trip(empty(pages)).count() == 0
    with pytest.raises(warc.WarcError):
        warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n")


# 8
def test_resample(spark, docs, odd):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    out = resample.select(docs, labels, 0.5).collect()
    ordered = sorted((r.key for r in out), reverse=True)
    assert sum(r.kept for r in out) == len(out) // 2 and {r.key for r in out if r.kept} == set(ordered[: len(out) // 2])
    keys = spark.createDataFrame([(float(i % 7),) for i in range(100)], "key double")
    assert all(resample.threshold(keys, k) == sorted((float(i % 7) for i in range(100)), reverse=True)[k - 1] for k in (1, 15, 50, 100))
    got = resample.select(odd, labels.limit(0), 0.5).collect()
    assert len(got) == len(ODD) and sum(r.kept for r in got) == 4
    assert resample.select(empty(odd), labels).count() == 0


def test_resampling_is_that_of_plain_python(spark, docs):
    """Counts, log ratios, keys and the rows kept, with copies that tie at the threshold."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    own = [(r.doc_id, r.text) for r in docs.limit(120).collect()]
    rows = own + [(None, "copy of one"), (9000, "copy of one"), (9000, "copy of one"), (9001, None), (9002, "!!! ?")] + [(9000, "copy of one")] * 6
    good = {r.doc_id for r in labels.collect() if r.quality == 1 and not r.toxic}
    wrap = lambda x: (x + (1 << 63)) % (1 << 64) - (1 << 63)

    def buckets(t):
        h = [xxhash.xxh64_intdigest(w) & 0x7FFFFFFFFFFF for w in re.findall(r"\w+|[^\w\s]+", (t or "").lower())]
        pairs = [wrap(wrap(a * 0x9E3779B1) + wrap(b * 0x85EBCA6B)) >> 13 for a, b in zip(h, h[1:], strict=False)]
        return [x & (resample.BUCKETS - 1) for x in h + pairs]

    every, target = Counter(), Counter()
    for i, t in rows:
        every.update(buckets(t))
        target.update(buckets(t) if i in good else ())
    share = lambda c, b: (c[b] + resample.SMOOTH) / (sum(c.values()) + resample.SMOOTH * resample.BUCKETS)
    ratio = {b: np.log(share(target, b) / share(every, b)) for b in every}
    want = []
    for i, t in rows:
        weight = sum(ratio[b] for b in buckets(t))
        u = (xxhash.xxh64_intdigest(f"3\0{i}\0{t or ''}".encode()) + 0.5) / 2.0**64
        want.append((-1 if i is None else i, weight, weight - np.log(-np.log(u))))
    keys = sorted((k for _, _, k in want), reverse=True)
    tied = next(k for i, _, k in want if i == 9000)
    for count in (40, sum(k > tied for k in keys) + 3):  # the second cuts eight equal rows
        got = resample.select(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), labels, count / len(rows), seed=3).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, round(r.importance, 6), round(r.key, 6)) for r in got) == sorted((i, round(float(w), 6), round(float(k), 6)) for i, w, k in want)
        assert sorted((r.key for r in got if r.kept), reverse=True) == pytest.approx(keys[:count])


# 9
def plain_print(text):
    w = words("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, odd):
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(1000 + i, t) for i, t in ODD if i]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    prints = {i: plain_print(t) for i, t in rows}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    got = simhash.near_duplicates(table).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{prints[i]:016x}", root(i)) for i, _ in rows)
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "4", "6", "None"]
    assert simhash.near_duplicates(empty(odd)).count() == 0


def test_links_are_complete(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = [int(b) ^ sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 7), replace=False)) for b in base for _ in range(6)]
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in [*map(int, base), *near]})
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    want = {(a, b) for a, b in combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4}
    assert {tuple(r) for r in simhash.links(frame, 4).collect()} == want
    assert {tuple(r) for r in simhash.links(frame, 4, simhash.plan(frame, 4, (2, 5))).collect()} == want


def joins(df):
    """The join operators of the plan."""
    return set(re.findall(r"(\w+Join|CartesianProduct)\b", df._jdf.queryExecution().executedPlan().toString()))


def test_uncounted_sides_stay_off_the_driver(spark, tmp_path, monkeypatch):
    """Exploded probes and sides beyond the limit are shuffled, though their files look small."""
    spark.range(3000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    frame = spark.read.parquet(str(tmp_path / "fps"))
    assert joins(simhash.links(frame, 4, simhash.plan(frame, 4))) == {"SortMergeJoin"}
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert joins(shared.join_checked(frame, frame, ["fp"], how)) == {"BroadcastHashJoin"}
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 3000 * 32 - 1)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert joins(shared.join_checked(frame, frame, ["fp"], how, 32)) == {"SortMergeJoin"}


def test_near_duplicates_stage_stays_off_the_driver(spark, odd, monkeypatch):
    """Rows of repeated ids beyond the limit are shuffled, and the same rows stay."""
    want = simhash.keep_first(odd)
    monkeypatch.setattr(shared, "BROADCAST_BYTES", -1)
    kept = simhash.keep_first(odd)
    assert joins(kept) == {"SortMergeJoin"}
    assert sorted(map(repr, kept.collect())) == sorted(map(repr, want.collect()))


def test_crowded_values(spark):
    """Balls of hundreds of fingerprints, some bridged, in few part values: the components that all pairs give."""
    rng = np.random.default_rng(8)
    fps = {0}
    for center in (0, 0b11111, 1 << 40, (1 << 40) | 0b1111110000, 0xFFFF << 20):
        fps |= {center ^ sum(1 << int(k) for k in rng.choice(24, rng.integers(0, 4), replace=False)) for _ in range(90)}
    fps |= {int(x) >> 1 for x in rng.integers(0, 1 << 63, 50, dtype=np.uint64)}
    fps = sorted(fps)
    first = {x: x for x in fps}
    near = [(a, b) for a, b in combinations(fps, 2) if (a ^ b).bit_count() <= 2]
    for _ in fps:
        moved = [(x, y) for a, b in near for x, y in ((a, b), (b, a)) if first[x] < first[y]]
        if not moved:
            break
        for x, y in moved:
            first[y] = min(first[x], first[y])
    frame = spark.createDataFrame([(x,) for x in fps], "fp long")
    linked = {x for pair in near for x in pair}
    for by in (simhash.plan(frame, 2), simhash.plan(frame, 2, (2,))):
        for crowd in (4, 64, 10_000):
            assert {r.node: r.root for r in simhash.roots(frame, 2, by, crowd).collect()} == {x: first[x] for x in linked}


def test_number_of_parts_follows_the_rows():
    """More fingerprints call for fewer, wider parts: the quadratic share of the cost outgrows the probes."""
    def cost(n, m):
        width = simhash.BITS // m
        rows = [[0.0, *[n * (1 + sum(simhash.comb(width, e) for e in range(t + 1))) + simhash.CANDIDATE * n * n / 2**width * sum(simhash.comb(width, e) for e in range(t + 1)) / 2 for t in range(5)]] for _ in range(m)]
        return simhash.allocate(rows, 5)[0]

    best = [min((2, 3, 4, 5), key=lambda m: cost(n, m)) for n in (1e3, 1e5, 1e9)]
    assert best == [5, 3, 2]


def test_hub_of_many_links(spark):
    """A node with most of the links, joined by broadcast."""
    edges = spark.range(5000).selectExpr("id + 1 AS a", "0L AS b").union(spark.range(30).selectExpr("id + 9000 AS a", "id + 9001 AS b"))
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(5001)} | {i: 9000 for i in range(9000, 9031)}


def test_hot_keys_meet_by_broadcast(spark, monkeypatch):
    """The same rows whether keys are hot, and joined by broadcast, or not."""
    from loomgraph.llm.shared import cut, join_hot

    left = cut(spark.range(9000).selectExpr("IF(id % 3 = 0, 7, id) AS k", "id AS x").union(spark.range(2000).selectExpr("8L AS k", "id AS x")))
    right = cut(spark.range(8000).selectExpr("id AS k", "id * 2 AS y"))
    want = left.join(right, "k")
    for cold in (20_000, 10):
        monkeypatch.setattr("loomgraph.llm.shared.COLD", cold)
        got = join_hot(left, right, "k")
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
        edges = spark.range(5000).selectExpr("id + 1 AS a", "0L AS b").union(spark.range(30).selectExpr("id + 9000 AS a", "id + 9001 AS b"))
        assert {r.node: r.root for r in components(edges).collect()} == {i: 0 for i in range(5001)} | {i: 9000 for i in range(9000, 9031)}


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (102, 101), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in (100, 101, 102)}


def holds(text, items):
    """Whether a whole text, aligned without seeds, holds a copy of an item."""
    own = decontam.words(text)
    have = set(own)
    for item in items:
        known = {w: k for k, w in enumerate(dict.fromkeys(item))}
        if item and 2 * sum(w in have for w in item) >= len(item):  # as many matches a score of half needs
            ids = lambda ws: np.array([known.get(w, -1) for w in ws])  # noqa: B023, E731
            if decontam.smith_waterman(ids(item), ids(own))[0] >= len(item):
                return True
    return False


def test_pipeline(spark):
    """Against plain Python: letters, all pairs of fingerprints, alignment of whole texts, masking, and the library's ids. Spans of the bootstrap are the operator's own."""
    import corpus_pipeline
    import sentencepiece

    table = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in table.collect() if r.text and any(c.isalpha() for c in r.text)}
    prints, first = {i: plain_print(t) for i, t in texts.items()}, {i: i for i in texts}
    near = [(a, b) for a, b in combinations(sorted(texts), 2) if (prints[a] ^ prints[b]).bit_count() <= 4]
    for _ in texts:
        moved = [(x, y) for a, b in near for x, y in ((a, b), (b, a)) if first[x] < first[y]]
        if not moved:
            break
        for x, y in moved:
            first[y] = min(first[x], first[y])
    items = [decontam.words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text]
    texts = {i: t for i, t in texts.items() if first[i] == i and not holds(t, items)}
    kept = table.filter(table.doc_id.isin(list(texts)))
    more = {r.doc_id: [(s.start, s.kind, s.end) for s in r.more] for r in pii.find(kept).collect()}
    kinds, library, want = list(pii.KINDS), sentencepiece.SentencePieceProcessor(model_file=pieces.model_path()), {}
    for i, t in texts.items():
        spans = [(int(a), kinds.index(k), int(b)) for k, a, b in (s.split(":") for s in plain_spans(t).split(",") if s)]
        out, at = [], 0
        for a, k, b in sorted(spans + more[i], key=lambda s: (s[0], -s[2], s[1])):
            if a >= at:
                out += [t[at:a], f"[{kinds[k].upper()}]"]
                at = b
        want[i] = library.encode("".join(out) + t[at:])
    got = corpus_pipeline.run(spark, SF).collect()
    assert len(got) == len(want) > 100
    assert {r.doc_id: r.token_ids for r in got} == want


def test_pipeline_on_odd_tables(spark, odd, docs, tmp_path):
    """Nulls, repeats, empty and long texts, columns that clash, and no rows at all, through every stage."""
    import corpus_pipeline

    for name in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    clash = {"fingerprint": "f", "component_id": "c", "more": "m", "spans": "s", "at": "t", "row": "r", "__id": "i"}
    extra = [F.lit(v).alias(k) for k, v in clash.items()]
    table = docs.select("doc_id", "text", "lang", "source", "n_chars", *extra).filter("doc_id < 60").withColumn("doc_id", F.col("doc_id") + 100)
    real, other = [r.text for r in docs.filter("length(text) between 300 and 900").orderBy("doc_id").limit(2).collect()]
    plain = F.when(F.col("doc_id").isNull() | (F.col("doc_id") == 1), real).when(F.col("doc_id") == 6, F.concat(F.lit(other), F.lit(" "), "text")).otherwise(F.col("text"))
    odd = odd.withColumn("text", plain)
    rest = odd.select("doc_id", "text", "lang", F.lit("x").alias("source"), F.length("text").cast("long").alias("n_chars"), *extra)
    table = table.unionByName(table.filter("doc_id < 120")).unionByName(rest)
    table.write.parquet(str(tmp_path / "documents.parquet"))
    for source, least in ((table, 20), (table.limit(0), 0)):
        frame = source
        for name, stage in corpus_pipeline.STAGES:
            before = frame
            path = str(tmp_path / f"{name}{least}")
            stage(spark, before, str(tmp_path)).write.parquet(path)
            frame = spark.read.parquet(path)
            if name != "encode":
                assert sorted(frame.columns) == sorted(before.columns) and frame.exceptAll(before).count() == (0 if name != "redact" else frame.exceptAll(before).count())
            if least and name == "language":  # null, empty and letterless texts go, rows stay as often as they stand
                assert frame.filter("doc_id in (2, 3, 5)").count() == 0 and frame.filter(F.col("text") == real).count() >= 3
            if least and name == "near_duplicates":
                assert frame.filter("doc_id = 1").count() <= 1 and frame.filter("doc_id is null").count() == 1
                assert frame.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").count() == 0
            if least and name == "redact":
                row = frame.filter("doc_id = 6").first()
                assert row.text.endswith(" mail [EMAIL] or [IP]") and row.n_chars == len(row.text) and all(row[k] == v for k, v in clash.items())
        assert frame.count() >= least
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 20
