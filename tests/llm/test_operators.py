"""Operators of training-data pipelines against plain versions, and on odd tables."""

import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textward.llm import html, jaccard, language, leakage, pieces, quality, shards, topk, toxicity, urls
from textward.llm import words as W

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOCS = "doc_id bigint, text string, lang string, a string, node string, n string, label string, score string"
LONG = "word " * 300_000
ODD = [(1, None), (2, ""), (3, "   \n"), (4, "..."), (5, "one two"), (6, "one two"), (6, "one two"), (None, "the and of to"),
       (7, LONG), (8, "x" * 200_000), (9, "Ünïcode ▁ text 😀 日本")]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "x", "x", "x", "x", "x") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    return docs(spark, ODD)


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# ------------------------------------------------------------------ words
def test_words_agree_with_a_plain_split():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aB é\t\n,") for _ in range(rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    got = {}
    for w in W.words(pa.array(texts)):
        for i, (a, b) in enumerate(itertools.pairwise(w.bounds())):
            got[w.first + i] = [bytes(w.data[s:e]).decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == {i: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower)) for i, t in enumerate(texts)}
    h = W.hash_words(["b a b", "a"])
    assert h[0][0] == h[0][2] != h[0][1] == h[1][0]


# ------------------------------------------------------------------ 1 toxicity
def test_segments_are_the_maximal_ones():
    def plain(v):  # disjoint best segments: take the best of all, then go on left and right of it
        best = max(((sum(v[a:b]), a - b, a, b) for a in range(len(v)) for b in range(a + 1, len(v) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        s, _, a, b = best
        while v[a] <= 0:
            a += 1
        return plain(v[:a]) + [(a, b - 1, s)] + [(x + b, y + b, z) for x, y, z in plain(v[b:])]

    rng = random.Random(5)
    for _ in range(300):
        v = [rng.uniform(-1, 1) for _ in range(rng.randint(1, 14))]
        up = [i for i, x in enumerate(v) if x > 0]
        gaps = [0.0] + [sum(v[a + 1 : b]) for a, b in itertools.pairwise(up)]
        got = [(up[a], up[b], s) for a, b, s in toxicity.segments([v[i] for i in up], gaps)]
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in plain(v)]


def test_toxicity_finds_unseen_forms_and_leaves_clean_text(spark, odd, empty):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        words = [rng.choice("alpha beta gamma delta river stone cloud".split()) for _ in range(40)]
        if i % 5 == 0:
            words[rng.randrange(40)] = rng.choice(["horridible", "horridishly", "vileword"])
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    model = toxicity.learn(docs(spark, rows), lab)
    new = docs(spark, [(1, "alpha beta horridionally gamma"), (2, "alpha beta gamma delta"), (3, None)])
    out = {r.doc_id: r.f for r in new.select("doc_id", toxicity.detect(F.col("text"), model).alias("f")).collect()}
    assert out[1].score >= 0.7 and out[2].score < 0.3 and out[3].score == out[2].score
    assert [(p["first"], p["last"]) for p in out[1].passages] == [(2, 2)] and out[2].passages == []
    assert odd.select(toxicity.detect(F.col("text"), model)).count() == len(ODD)
    nothing = toxicity.learn(empty, lab)
    assert {r[0].score for r in new.select(toxicity.detect(F.col("text"), nothing)).collect()} == {0.5}


# ------------------------------------------------------------------ 2 pieces
def test_viterbi_against_all_segmentations():
    texts = ["▁", "a", "b", "ab", "ba", "aba", "▁a", "bb", "abab"]
    rng = random.Random(3)
    table = {t: (i + 256, -rng.uniform(1, 9)) for i, t in enumerate(texts)}
    model = pieces.build(table, {b: b for b in range(256)}, 256 + len(texts))

    def best(t):
        top = {0: 0.0}
        for e in range(1, len(t) + 1):
            options = [top[s] + table[t[s:e]][1] for s in range(e) if t[s:e] in table and s in top]
            if t[e - 1] not in table:
                options.append(top[e - 1] + model.unknown)
            top[e] = max(options)
        return top[len(t)]

    for n in range(1, 7):
        for t in map("".join, itertools.product("abé", repeat=n)):
            ids, counts = pieces.encode_all([t], model)
            score = sum(model.scores[i] for i in ids if i >= 256) + model.unknown * t.count("é")
            assert abs(score - best(pieces.MARK + t)) < 1e-9 and pieces.decode_all(ids, counts, model) == [t]
            assert list(pieces._long((pieces.MARK + t).encode(), model)) == list(ids)


def test_pieces_round_trip(spark, odd, empty):
    model = pieces.load(MODEL)
    rows = odd.select("text", pieces.encode(F.col("text"), model).alias("c")) \
        .select("text", "c", pieces.decode(F.col("c.ids"), model).alias("back")).collect()
    for r in rows:
        assert r.c.intact == ("▁" not in (r.text or ""))
        assert r.back == (r.text.replace("▁", " ") if r.text is not None else None)
        assert (r.c.ids is None) == (r.text is None)
    assert empty.select(pieces.encode(F.col("text"), model)).count() == 0


# ------------------------------------------------------------------ 3 quality
def test_quality_ranks_held_out_documents(spark, odd, empty):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice("the river and a stone of cloud".split()) for _ in range(40)) + "."
    bad = lambda: " | ".join(rng.choice("ALPHA$$ BETA%% GAMMA##".split()) for _ in range(40))
    rows = [(i, good() if i % 4 else bad()) for i in range(200)]
    lab = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(200)], "doc_id bigint, quality int")
    model = quality.learn(docs(spark, rows), lab)
    new = docs(spark, [(1, good()), (0, bad())])
    s = {r.doc_id: r.s for r in new.select("doc_id", quality.score(F.col("text"), model).alias("s")).collect()}
    assert s[1] > 0.9 and s[0] < quality.CUT
    assert all(0 <= r[0] <= 1 for r in odd.select(quality.score(F.col("text"), model)).collect())
    for labels in (lab.filter("quality = 1"), lab.limit(0)):
        constant = quality.learn(docs(spark, rows), labels)
        assert len({r[0] for r in new.select(quality.score(F.col("text"), constant)).collect()}) == 1
    assert quality.learn(empty, lab).weights.shape == (len(quality.NAMES),)


# ------------------------------------------------------------------ 4 urls
def test_urls(spark):
    rows = [(1, "https://WWW.Example.org/en/17?x"), (2, "http://a.example.org/es/"), (3, None), (4, "no-scheme/path"),
            (5, "x://b.net"), (6, "http://bad.net/a/"), (7, "https://www.bad.net/a#f"), (7, "https://www.bad.net/a#f"),
            (8, "http://fakeorg/en/1"), (9, "http://h?q=/p"), (10, "http://com/fr/x"), (11, "a://b://c/d")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id int, url string, host string, canonical string")
    listed = spark.createDataFrame([("bad.net/a",), ("bad.net/a",), (None,)], "canonical string")
    rules = [urls.Rule("allow", "org", "/"), urls.Rule("block", "example.org", "/en/1"), urls.Rule("allow", "com", "/fr/")]
    for blocks in (1, 1024):
        out = [tuple(r)[:5] for r in urls.judge(pages, rules, listed, blocks=blocks).orderBy("page_id").collect()]
        assert out == [
            (1, "www.example.org", "/en/17", "example.org/en/1", "block"), (2, "a.example.org", "/es/", "org/", "allow"),
            (3, "", "", None, "allow"), (4, "", "", None, "allow"), (5, "b.net", "", None, "allow"),
            (6, "bad.net", "/a/", None, "block"), (7, "www.bad.net", "/a", None, "block"),
            (7, "www.bad.net", "/a", None, "block"), (8, "fakeorg", "/en/1", None, "allow"), (9, "h", "", None, "allow"),
            (10, "com", "/fr/x", "com/fr/", "allow"), (11, "b:", "//c/d", None, "allow")]
    assert urls.judge(pages.limit(0), rules, listed).count() == 0
    assert urls.judge(pages, [], listed.limit(0)).filter("verdict = 'block'").count() == 0


# ------------------------------------------------------------------ 5 shards
def test_lookup_table(spark, odd):
    names = [f"s{i}" for i in range(7)]
    table = shards.lookup_table(names, 1009)
    sizes = np.bincount(table)
    assert sizes.max() - sizes.min() <= 1
    fewer = shards.lookup_table(names[:-1], 1009)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 6)
    assert moved < 0.2 * 1009  # those that keep their shard are many
    with pytest.raises(ValueError):
        shards.lookup_table(names, 1000)
    out = shards.place(odd.withColumn("slot", F.lit(1)), "doc_id", names, 1009)
    assert out.count() == len(ODD) and out.filter("shard IS NULL").count() == 0
    assert out.filter("doc_id = 6").select("shard").distinct().count() == 1


# ------------------------------------------------------------------ 6 near duplicates
def plain_groups(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set())
    group = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            x, y = group[i], group[j]
            group = [x if g == y else g for g in group]
    least = {g: min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in group}
    return sorted((rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows)))


def test_groups_against_all_pairs(spark, empty):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(40)]
    rows = [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (1004, "\t")]
    for family in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.randint(1, 14)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                copy += rng.choices(vocabulary, k=rng.randint(1, 8))
            rows.append((len(rows) * 3 + family, " ".join(["Common line of text here"] * (family % 2) + copy)))
    got = sorted(tuple(r) for r in jaccard.groups(docs(spark, rows)).collect())
    assert got == plain_groups(rows)
    assert jaccard.groups(empty).count() == 0


def test_groups_of_odd_rows(spark, odd):
    out = [tuple(r) for r in jaccard.groups(odd).collect()]
    assert len(out) == len(ODD) and out.count((6, 1, 5)) == 2 and (5, 1, 5) in out and (2, 0, 2) in out


# ------------------------------------------------------------------ 7 top-k
def test_top_k_against_all_pairs(spark):
    rng = random.Random(7)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.3, 0.3, 2.0]) for _ in range(6)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")]), (63, [float("inf")]), (64, []), (65, [1.0]), (None, [1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, v array<float>").withColumn("score", F.lit("x"))
    vectors = topk.quantized(df, "vec_id", "v")
    got = sorted(tuple(r) for r in topk.top_k(vectors.filter("vec_id % 5 = 0"), vectors, 5).collect())
    q = {i: [int(np.floor(256 * float(np.float32(x)))) for x in v] for i, v in rows
         if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    want = []
    for a in (i for i in q if i % 5 == 0):
        s = sorted((-sum(x * y for x, y in zip(q[a], q[b], strict=False)), b) for b in q if b != a)[:5]
        want += [(a, k + 1, b, -x) for k, (x, b) in enumerate(s)]
    assert got == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors, 5).count() == 0 == topk.top_k(vectors, vectors.limit(0), 5).count()


# ------------------------------------------------------------------ 8 html
PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Site <b>name</b></header>
<nav><ul><li><a href="/a">A</a></ul></nav><div class="cookie-notice">We use cookies on this site.</div>
<main><article><h1>Head &amp; tail</h1><p>First&nbsp;  part <b>bold<br>more</p><p>Of.<p>The last &lt;one&gt;
<div class="ad">Buy the thing now</div><form><p>Your name <input></form></article>
<section id="comments"><p>I think that this is the best of all the texts that I have read in my life.</p></section></main>
<aside>Other news</aside><script>var x = "</p><p>not text</p>";</script><footer>&copy; me</footer></body></html>"""


def test_main_text():
    assert html.main_text(PAGE) == "Head & tail\n\nFirst part bold more\n\nOf.\n\nThe last <one>"
    prose = "It is the end of the road and we are not there yet, but that is what they said to all of us. " * 4
    plain = f"<div>Menu</div><div><a href=x>Home page of the site</a></div><h2>Title</h2><p>{prose}</p><p>Short.</p><p>{prose}</p><div>© 2020 us</div>"
    assert html.main_text(plain) == f"Title\n\n{prose.strip()}\n\nShort.\n\n{prose.strip()}"
    assert [html.main_text(x) for x in (None, "", "   ", "<p", "<!-- x", "<script>alert(1)")] == [""] * 6
    assert html.main_text("<article><p>" + "the word " * 200_000).count("word") == 200_000
    assert html.main_text("<article><p>" * 3000 + "deep").endswith("deep")


# ------------------------------------------------------------------ 9 leakage
def test_leaks_of_exact_and_changed_passages(spark, odd, empty):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(3000)]
    common = "the of and to in a is that".split()
    text = lambda n: " ".join(rng.choice(common if rng.random() < 0.4 else vocabulary) for _ in range(n))
    items = [(i, text(30).capitalize() + ". " + text(8) + ".") for i in range(20)] + [(20, None), (21, "..."), (22, "one two")]
    rows = [(i, text(150)) for i in range(60)]
    for i in range(10):
        words = items[i][1].split()
        if i % 2:  # paraphrase: some words changed, one dropped, case and marks differ
            for j in range(0, 36, 9):
                words[j] = rng.choice(vocabulary)
            del words[12]
            words = [w.upper() + "," for w in words]
        rows.append((100 + i, f"{text(40)} {' '.join(words)} {text(60)}"))
    table = docs(spark, rows)
    bench = spark.createDataFrame(items + [items[0]], "item_id bigint, text string")
    indexes = leakage.learn(table, bench)
    found = {(r.doc_id, r.k.item_id) for r in table.select("doc_id", F.explode(leakage.leaks(F.col("text"), indexes)).alias("k")).collect()}
    assert found == {(100 + i, i) for i in range(10)}
    hits = {r.doc_id: [k.item_id for k in r.k] for r in odd.select("doc_id", leakage.leaks(F.col("text"), indexes).alias("k")).collect()}
    assert hits[5] == hits[6] == [22] and not any(hits[i] for i in (1, 2, 3, 4, 7, 8, 9))
    assert leakage.learn(table, bench.limit(0)) == []
    assert table.select(leakage.leaks(F.col("text"), []).alias("k")).filter("size(k) > 0").count() == 0
    assert empty.select(leakage.leaks(F.col("text"), leakage.learn(empty, bench))).count() == 0


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0, *itertools.accumulate(range(len(b)), lambda left, j, r=row, x=x: r[j] + 1 if x == b[j] else max(r[j + 1], left), initial=0)][1:]
        return row[-1]

    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(4) for _ in range(rng.randint(1, 12))] for _ in range(2))
        assert leakage.common(np.array(a), np.array(b)) == plain(a, b)


# ------------------------------------------------------------------ 10 language
def plain_language(text, profiles_of):
    c = "".join(x if x.isalpha() else " " for x in text.lower())
    c = f" {c} "
    counts = {}
    for n in (1, 2, 3):
        for i in range(len(c) - n + 1):
            g = c[i : i + n]
            if (n == 1 and g == " ") or (n == 2 and g == "  ") or (n == 3 and g[1] == " "):
                continue
            counts[(n, g)] = counts.get((n, g), 0) + 1
    return sorted(counts, key=lambda k: (-counts[k], k[0], [0 if x == " " else ord(x) for x in k[1]]))[:profiles_of]


def test_grams_against_a_plain_count():
    for text in ("Hello, wörld! aa", "ab", "", "12", "a  b"):
        codes, counts = language.gram_counts(text)
        top = codes[np.argsort(-counts, kind="stable")]
        got = []
        for x in top.tolist():
            n = x >> 48
            points = [x >> 16 * k & 0xFFFF for k in range(n - 1, -1, -1)]
            got.append((n, "".join(chr(p) if p else " " for p in points)))
        assert got == plain_language(text, 10**6)


def test_language(spark, odd, empty):
    rows = [("the cat and the dog of this house", "en"), ("der hund und die katze nicht das haus", "de"), (None, "fr"), ("x", None)]
    profiles = language.learn(spark.createDataFrame(rows * 3, "text string, lang string"))
    assert profiles.languages == ["de", "en"]
    assert language.decide("the dog and this", profiles)[0] == "en" and language.decide("und das haus", profiles)[0] == "de"
    assert language.decide("123 !?", profiles) == ("und", 0.0) == language.decide(None, profiles)
    out = odd.select("doc_id", language.identify(F.col("text"), profiles).alias("f")).collect()
    assert len(out) == len(ODD) and all(0 <= r.f.score <= 1 for r in out)
    assert language.decide("word", language.learn(empty))[0] == "und"


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    columns = documents.columns
    left = documents
    for name, stage in corpus_pipeline.STAGES:
        before = {r[0] for r in left.select("doc_id").collect()}
        stage(spark, left, sf).write.parquet(str(tmp_path / name))
        left = spark.read.parquet(str(tmp_path / name))
        after = {r[0] for r in left.select("doc_id").collect()}
        assert after <= before
        if name != "pieces":
            assert left.columns == columns
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(tmp_path / "language")).collect()]
            assert after == {g for _, _, g in plain_groups(rows)}
    assert left.filter("NOT intact").count() == 0 and left.count() > 100


def test_remainder_is_crc32(spark):
    from textward.llm.labels import remainder

    out = spark.range(50).select("id", remainder(F.col("id"), 4).alias("r")).collect()
    assert all(r.r == zlib.crc32(str(r.id).encode()) % 4 for r in out)


# ------------------------------------------------------------------ whole results
@pytest.mark.parametrize("scale", [1, 10**6])
def test_short_copies_are_found_at_any_offset_in_any_corpus(scale):
    rng = random.Random(10)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    items = leakage._items([(n, " ".join(rng.choices("the of and to in a is that".split(), k=n // 2)
                                         + rng.sample(vocabulary, n - n // 2))) for n in range(3, 41)])
    total = 1000 * scale
    weights = np.log((total + 1) / (np.array([rng.choice([2, 40, 400]) for _ in items.terms]) * scale + 1)) + 0.05
    rows, owner = leakage._item_passages(items)
    space = leakage._leading(leakage._gram_times(rows, weights, r := np.random.default_rng(1).standard_normal(
        (len(items.terms), leakage.SKETCH)).astype(np.float32)), r)
    index = leakage.Index(items, weights, float(np.log(total + 1) + 0.05), space,
                          leakage._unit(leakage._project(rows, weights, space)), owner, leakage._anchors(items, weights))
    foreign = lambda n: [f"foreign{rng.randrange(9999)}" for _ in range(n)]
    terms = items.terms
    for i, n in enumerate(items.ids):
        for offset in range(16):
            t = np.concatenate([np.full(offset, -1), items.words[i], np.full(40, -1)])
            words = W.hash_words([" ".join(foreign(offset) + ["x"] * n + foreign(40))], W.ALNUM)[0].copy()
            words[t >= 0] = terms[t[t >= 0]]
            found = leakage._search(FakeWords(words), index)
            assert (0, n, 1.0) in {f[:3] for f in found}, (n, offset)


class FakeWords:
    """One document of the given word hashes."""

    first = 0

    def __init__(self, hashes):
        self.hash = hashes

    def bounds(self):
        return np.array([0, len(self.hash)])


def test_one_of_each_with_null_and_repeated_ids(spark, empty):
    rng = random.Random(12)
    unique = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c, d = unique(), unique(), unique(), unique()
    near = lambda t: t + " tail"
    rows = [(1, a), (2, near(a)), (2, b), (None, c), (None, near(c)), (None, d), (5, near(d)), (6, None), (None, None),
            (None, None), (None, ""), (6, "a b"), (7, "A  b")]
    kept = [(r.doc_id, r.text) for r in jaccard.one_of_each(docs(spark, rows)).collect()]
    assert len([t for _, t in kept if t in (c, near(c))]) == 1
    kept.remove((None, c) if (None, c) in kept else (None, near(c)))
    assert sorted(kept, key=str) == sorted([(1, a), (2, b), (5, near(d)), (6, None), (None, None), (None, ""), (6, "a b")], key=str)
    assert jaccard.one_of_each(empty).count() == 0
    groups = {(r.doc_id, r.component_id) for r in jaccard.groups(docs(spark, [(None, c), (None, near(c)), (9, near(c) + " x")])).collect()}
    assert groups == {(None, 9), (9, 9)}


def test_pipeline_stages_on_odd_rows(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    good = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").filter("lang = 'en'").orderBy("doc_id").limit(40).collect()]
    table = spark.createDataFrame([(i, t, "en", "x", 1) for i, t in ODD + list(enumerate(good, 100)) + [(None, t) for t in good]],
                                  "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, table, sf).collect()
        if name == "near_duplicates":
            named = [(i, t) for i, t in ODD if i is not None] + list(enumerate(good, 100))
            assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted({g for _, _, g in plain_groups(named)})
            assert [r.text for r in out if r.doc_id is None] == ["the and of to"]
        elif name == "pieces":
            assert len(out) == table.count()
        else:  # equal texts share their fate, whatever their id
            assert {r.text for r in out if r.doc_id is None} >= {r.text for r in out if (r.doc_id or 0) >= 100} != set()


def test_neighbours_decide_inside_an_article_too():
    prose = "It is the end of the road and we are not there yet, but that is what they said to all of us. " * 4
    advert, form = '<div class="ad">Buy it</div>', "<form>Your name</form>"
    page = f"<article><p>{prose}</p>{advert}<p>Great offers every day</p>{form}<p>Short end.</p></article>"
    assert html.main_text(page) == f"{prose.strip()}\n\nShort end."
    foreign = "Zażółć gęślą jaźń " * 20  # no function words at hand: nothing certain, so nothing goes
    assert html.main_text(f"<article>{advert}<p>{foreign}</p>{form}</article>") == foreign.strip()
    assert html.main_text(f"<article><p>{prose}</p>{advert}<p>{foreign}</p>{form}</article>") == f"{prose.strip()}\n\n{foreign.strip()}"
    outside = f"<article><p>{prose}</p></article><div>{prose}</div><div>And so it was.</div><div>{prose}</div>"
    assert "And so it was." in html.main_text(outside)
    assert "Alone" not in html.main_text(f"<article><p>{prose}</p></article><div>Alone</div>")


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = ODD + [(None, f"null {i}") for i in range(50)] + [(77, f"hot {i}") for i in range(200)] + [(i, "x") for i in range(100, 200)]
    names = [f"s{i}" for i in range(5)]
    table = docs(spark, rows).select("doc_id", "text")
    shards.write_shards(table, str(tmp_path / "out"), "doc_id", names, files=3, size=1009)
    key = lambda r: (str(r[0]), str(r[1]), r[2])
    written = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "text", "shard").collect()]
    placed = [tuple(r) for r in shards.place(table, "doc_id", names, 1009).select("doc_id", "text", "shard").collect()]
    assert len(written) == len(rows) and sorted(written, key=key) == sorted(placed, key=key)
    assert len({s for i, _, s in written if i is None}) == len({s for i, _, s in written if i == 77}) == 1
    assert all(len(list(folder.glob("*.parquet"))) <= 3 for folder in (tmp_path / "out").glob("shard=*"))


def test_rows_of_long_texts_leave_the_jaccard_steps_in_batches_of_bounded_bytes():
    rng = np.random.default_rng(5)
    texts = [" ".join(map(str, rng.integers(0, 10**9, 1_000))) for _ in range(600)]
    rows = pa.RecordBatch.from_pydict({"text": texts + [None, ""]})
    made = list(jaccard._members(5)(iter([rows])))
    whole = pa.Table.from_batches(made).combine_chunks().to_batches()[0]
    assert whole.column("node").to_pylist() == [jaccard._name(s) for s in jaccard.ngram_sets(rows.column("text")) if len(s)]
    cut = list(jaccard._fragments(iter([whole])))
    assert sum(b.num_rows for b in cut) == 600 * jaccard.FRAGMENTS
    ranged = list(jaccard._sets_to_ranges(3)(iter([whole])))
    assert sorted(m for b in ranged for x in b.column("members") for m in np.frombuffer(x.as_py(), np.uint64)) \
        == sorted(m for x in whole.column("members") for m in np.frombuffer(x.as_py(), np.uint64))
    assert max(b.nbytes for b in [*made, *cut, *ranged]) < 2 * jaccard.SLICE < whole.nbytes


def test_rows_between_the_jaccard_steps_grow_with_the_input(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "RANGE", 1_000, raising=False)  # n-grams sorted together by the code before
    plain, made = type(spark.range(1)).mapInArrow, {}

    def counted(self, step, schema):
        rows = made.setdefault(schema, [])
        rows.append(spark.sparkContext.accumulator(0))
        total = rows[-1]

        def run(batches):
            for batch in step(batches):
                total.add(batch.num_rows)
                yield batch
        return plain(self, run, schema)

    monkeypatch.setattr(type(spark.range(1)), "mapInArrow", counted)
    counts = []
    for families in (20, 100):
        made.clear()
        rows = [(4 * f + c, " ".join(f"w{f}x{i}" for i in range(60 + c))) for f in range(families) for c in range(4)]
        got = sorted(tuple(r) for r in jaccard.groups(docs(spark, rows)).collect())
        assert got == [(4 * f + c, 56 + c, 4 * f) for f in range(families) for c in range(4)]
        counts.append({schema: sum(a.value for a in rows) for schema, rows in made.items()})
    assert all(0 < counts[0][schema] and large <= 6 * counts[0][schema] for schema, large in counts[1].items())
