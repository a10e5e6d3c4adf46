"""The training-data operators against brute force, exact round trips and defined edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import exact_dedup, langid, media, mixing, packing, pii, quality, simhash, toxicity, url_filters
from corpusmill.llm.components import connected_components
from corpusmill.llm.queries import URL_RULES

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, rows, parts=3):
    """Rows (doc_id, text[, lang, source]) as a documents table with a clashing extra column."""
    full = [(*r, *[None] * (4 - len(r)), len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumn("d", F.lit("extra")).withColumn("fp", F.lit(1)).repartition(parts)


def union_find(nodes, pairs):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


# -- components -----------------------------------------------------------------------------------


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + k, 101 + k) for k in range(30)] + [(7, None), (200, 200)] + [(300, 301 + k) for k in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(df, "a", "b").collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    assert got == union_find({x for e in real for x in e}, real)
    assert connected_components(df.limit(0), "a", "b").count() == 0


# -- 1 -------------------------------------------------------------------------------------------------


def test_url_parts_and_rules(spark):
    urls = ["http://A.Example.COM/en/7x?q#f", "http://a.example.com/en/6", "https://x.net/de/1", "https://www.example.net/de/8#", "no scheme", None, "http://h?x/en/", "ftp://org/es/", "http://xcom/en/", "://com/en/", "http://com"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    got = {r["page_id"]: tuple(r)[1:5] for r in url_filters.judge_urls(df, URL_RULES).collect()}
    assert got == {
        0: ("a.example.com", "/en/7x", "example.com/en/7", "allow"), 1: ("a.example.com", "/en/6", "com/en/", "block"), 2: ("x.net", "/de/1", "net/de/", "allow"),
        3: ("www.example.net", "/de/8", "example.net/de/8", "block"), 4: ("", "", None, "allow"), 5: ("", "", None, "allow"), 6: ("h", "", None, "allow"), 7: ("org", "/es/", "org/es/", "block"),
        8: ("xcom", "/en/", None, "allow"), 9: ("com", "/en/", "com/en/", "block"), 10: ("com", "", None, "allow"),
    }
    assert url_filters.judge_urls(df.limit(0), URL_RULES).count() == 0


def test_blocks_follow_aliases(spark):
    canonical = '<link rel="canonical" href="{}">'
    rows = [
        (1, "http://a.io/x", canonical.format("/y")), (2, "http://a.io/y#top", "<META content='0; URL=http://b.org/es/1' http-equiv=refresh>"), (3, "http://b.org/es/1", ""),
        (4, "http://c.net/de/1", canonical.format("http://a.io/y")), (5, "http://d.io/", canonical.format("http://e.io/")), (6, "http://e.io", None), (7, "http://a.io/x", None),
        (8, "http://f.io/", "<!-- " + canonical.format("http://b.org/es/1") + " -->"), (9, None, canonical.format("http://b.org/es/1")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("node", F.lit(1)).withColumn("k", F.lit(2))
    got = {r["page_id"]: r["verdict"] for r in url_filters.judge_urls(df, URL_RULES).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow", 7: "block", 8: "allow", 9: "allow"}


# -- 2 --------------------------------------------------------------------------------------------------


def good_and_bad(n, seed):
    rng = random.Random(seed)
    for k in range(n):
        words = ["".join(rng.choice(["th", "er", "on", "an", "re"]) for _ in range(rng.randint(1, 4))) for _ in range(60)]
        bad = k % 4 == 0
        text = " ".join(w + rng.choice(["%%%", "$$$"]) for w in words) if bad else " ".join(words).capitalize() + "."
        yield k, text, "en", f"s{k % 3}", int(not bad)


def test_quality_held_out(spark):
    rows = list(good_and_bad(400, 1))
    df = documents(spark, [r[:4] for r in rows] + [(1000, None), (1001, ""), (1002, "x " * 5000)])
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2] + [(r[0], r[4]) for r in rows[::8]] + [(None, 1), (3, None)], "doc_id long, quality int")
    found = quality.quality(df, labels)
    got = {r["doc_id"]: r for r in found.collect()}
    assert len(got) == 403 and all(0 <= r["score"] <= 1 for r in got.values())
    held = [r for r in rows if r[0] % 2 == 0 and r[0] % 8]
    assert np.mean([got[r[0]]["kept"] == bool(r[4]) for r in held]) > 0.97
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {k for k, r in got.items() if r["kept"]}
    none = quality.quality(df, labels.limit(0)).collect()
    assert all(r["score"] == 0.5 and r["kept"] for r in none)
    assert quality.quality(df.limit(0), labels).count() == 0


def quality_by_hand(model, text, lang, source, n_chars):
    """The three scores, byte by byte and with plain sums."""
    raw = (text or "").encode()
    classes = ["aeiouy", "bcdfghjklmnpqrstvwxz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",", "!?", "|", "$%&*#^~@+=<>\\", "\"'`()[]{}", "-_/:;"]
    kind = lambda b: 14 if b >= 192 else 13 if b >= 128 else next((k for k, x in enumerate(classes) if chr(b) in x), 15)
    c, words, lines = [kind(b) for b in raw], raw.split(), [x for x in raw.split(b"\n") if x]
    grams = [256 * x + 16 * y + z for x, y, z in zip(c, c[1:], c[2:])]
    n, size = max(1, len(words)), max(1, len(raw))
    ratios = [
        len(set(words)) / n if n < 200 else min(1.0, len(set(words)) / n**0.9), sum(x == y for x, y in zip(words, words[1:])) / n, min(len(raw) / n, 30) / 10,
        len(set(lines)) / max(1, len(lines)), c.count(10) / size * 5, c.count(2) / size * 5,
    ]
    w, m = model.content.tolist(), model.meta.tolist()
    first = 10 * sum(w[g] for g in grams) / max(1, len(grams)) + sum(x * y for x, y in zip(ratios, w[4096:4102])) + w[4102]
    bucket = lambda x: 0 if x is None else 1 + zlib.crc32(x.encode()) % 63
    chars = len(text or "") if n_chars is None else n_chars
    layout = min(15, int(2 * math.log2(1 + chars / ((text or "").count("\n") + 1)))) if chars else 0
    second = m[bucket(lang)] + m[64 + bucket(source)] + m[128 + min(31, int(2 * math.log2(1 + chars)))] + m[160 + layout] + m[-1]
    z = [a * x + b for (a, b), x in zip(model.scale, (first, second))]
    z.append(model.mix[0] * z[0] + model.mix[1] * z[1] + model.mix[2])
    return [1 / (1 + math.exp(-max(-30, min(30, x)))) for x in z]


def test_quality_by_hand(spark):
    rows = list(good_and_bad(300, 2))
    df = documents(spark, [r[:4] for r in rows] + [(1000, None), (1001, ""), (1002, "é %\nxx  \t9" * 90, "de", "s1")])
    labels = spark.createDataFrame([(r[0], r[4]) for r in rows if r[0] % 2] + [(r[0], r[4]) for r in rows[::8]], "doc_id long, quality int")
    model = quality.train_from(df, labels)
    got = {r["doc_id"]: (r["content_score"], r["metadata_score"], r["score"]) for r in quality.score_quality(df, model).collect()}
    for r in df.collect():
        assert got[r["doc_id"]] == pytest.approx(quality_by_hand(model, r["text"], r["lang"], r["source"], r["n_chars"]), abs=1e-9)


def test_pool_and_labelled_sample_are_apart(spark, monkeypatch):
    """Where all documents have labels, the views still see others than the labelled sample; long texts don't use up its places."""
    seen = {}
    monkeypatch.setattr(quality, "co_train", lambda known, pool: seen.update(known={r["id"] for r in known}, pool={r["id"] for r in pool}))
    df = documents(spark, [(k, "word " * (30_000 if k % 3 == 0 else 5)) for k in range(300)])
    quality.train_from(df, spark.createDataFrame([(k, k % 2) for k in range(400)], "doc_id long, quality int"), labelled=100, unlabelled=60)
    assert len(seen["known"]) == 100 and len(seen["pool"]) == 60 and not seen["known"] & seen["pool"] and all(k % 3 for k in seen["known"] | seen["pool"])


def test_text_of_another_type(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(20)], "doc_id long, text double")
    labels = spark.createDataFrame([(k, k % 2) for k in range(20)], "doc_id long, quality int")
    kept = quality.keep_good(df, labels)
    assert kept.schema == df.schema and {r["doc_id"] for r in kept.collect()} == {r["doc_id"] for r in quality.quality(df, labels).collect() if r["kept"]}


# -- 3 ---------------------------------------------------------------------------------------------------


def test_toxicity_held_out(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("aeiou") + rng.choice("bdgklmnrst") for _ in range(rng.randint(1, 3)))
    rows = []
    for k in range(600):
        sents = [" ".join(word() for _ in range(8)) for _ in range(rng.randint(1, 6))]
        bad = k % 5 == 0
        if bad:
            sents[rng.randrange(len(sents))] += " " + rng.choice(["vilezzz", "grubqqq"])
        rows.append((k, ". ".join(sents) + ".", int(bad)))
    df = documents(spark, [r[:2] for r in rows] + [(9000, None), (9001, ""), (9002, "... \n"), (None, rows[0][1])])
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(df, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, r in got.items() if k is not None)
    assert np.mean([got[k]["predicted"] == t for k, _, t in rows if got[k]["held_out"]]) > 0.98
    assert got[9000]["score"] == got[9001]["score"] == got[9002]["score"] == 0.0 and got[None]["predicted"] == 1
    weights = toxicity.train_words([r[1] for r in rows], [r[2] for r in rows])
    spans = toxicity.offending_sentences(df, weights).collect()
    assert spans and all(re.search("vilezzz|grubqqq", r["words"]) for r in spans)
    by_hand = {k: toxicity.document_score(t, weights) for k, t, _ in rows}
    assert all(abs(r["score"] - by_hand[r["doc_id"]]) < 1e-9 for r in toxicity.score_documents(df.where("doc_id < 600"), weights).collect())
    assert all(r["predicted"] == 0 for r in toxicity.toxicity(df, labels.limit(0)).collect())


def noisy_or(text, weights):
    """A document's score, in plain Python and without the module's tables."""
    stay = 1.0
    for part in re.split(rb"[.!?\n\r]", (text or "").encode()):
        words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", part)
        seen = {w.lower() for w in words}
        seen |= {b"^" + w[:k] for w in set(seen) for k in (4, 5, 6) if len(w) >= k}
        total = sum(weights.get(f, 0.0) for f in seen)
        p = 1 / (1 + math.exp(10 - total))
        stay *= 1 - p if total > 0 and p >= 0.02 else 1.0
    return 1 - stay


def test_scores_by_hand(spark):
    rng = random.Random(15)
    weights = {b"vile": 9.0, b"^grub": 5.5, b"^grubb": 3.0, b"damp": 2.0, "pfüi".encode(): 14.0}
    words = ["vile", "Vile", "grubby", "grub", "damp", "calm", "pfüi", "a1", "sea"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", ", ", ". ", "!", "\n", "?? "]) for _ in range(rng.randint(0, 30)))) for k in range(200)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(documents(spark, rows), weights).collect()}
    assert all(got[k] == pytest.approx(noisy_or(t, weights), abs=1e-9) for k, t in rows) and len({round(x, 3) for x in got.values()}) > 10


def test_length_is_not_toxic(spark):
    weights = {b"vile": 12.0, b"calm": 3.0}
    rows = [(1, "A calm day. " * 50_000), (2, "A villa by the sea. " * 50_000), (3, "A calm day. " * 20_000 + "How vile!")]
    got = {r["doc_id"]: r for r in toxicity.score_documents(documents(spark, rows), weights).collect()}
    assert got[1]["score"] == got[2]["score"] == 0 and got[3]["score"] > 0.8 and got[3]["n_offending"] == 1
    assert all(abs(got[k]["score"] - toxicity.document_score(t, weights)) < 1e-9 for k, t in rows)


# -- 4 -------------------------------------------------------------------------------------------------------


def test_tokens_match_the_tokenizer():
    model = packing.word_tokens(packing.tokenizer_path())
    odd = "don't it's WE'LL ''s 's x1234.5 ab,. a,b İ É é ẞß ΑΣ 日本語 ½ ²3 a\x1cb z\x85q <|endoftext|> <|ENDOFTEXT|> naïve! ok. no, "
    rng = random.Random(3)
    texts = [odd, "", None, "a", "x" * 3000, *("".join(rng.choice("aeThé., \n'1!<|") for _ in range(200)) for _ in range(60))]
    for _ in range(2):  # the second time from the cache
        for text, ids in zip(texts, model.ids(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == model.whole.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_best_fit(sizes):
    x = np.array(sizes, np.int64)
    bins, offsets, room = packing.best_fit_decreasing(x, 40)
    held = defaultdict(list)
    for b, o, s in zip(bins.tolist(), offsets.tolist(), sizes):
        held[b].append((o, s))
    for b, places in held.items():
        places.sort()
        assert [o for o, _ in places] == [sum(s for _, s in places[:k]) for k in range(len(places))]
        assert room[b] == 40 - sum(s for _, s in places) >= 0
    assert packing.lower_bound(x, 40) <= len(room)
    if len(sizes) <= 7 and sizes:  # the bound never exceeds the optimum
        best = min(len(set(c)) for c in itertools.product(range(len(sizes)), repeat=len(sizes)) if all(sum(s for s, k in zip(sizes, c) if k == b) <= 40 for b in set(c))) if len(sizes) <= 5 else len(room)
        assert packing.lower_bound(x, 40) <= best


def test_pack_documents(spark):
    rng = random.Random(4)
    texts = {k: " ".join(rng.choice(["ab", "the", "tion", "x1", "é"]) for _ in range(rng.choice([0, 3, 50, 900, 4095, 9000]))) for k in range(40)}
    df = documents(spark, [*texts.items(), (99, None)])
    rows = packing.pack_documents(df).collect()
    model = packing.word_tokens(packing.tokenizer_path())
    pieces = defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
    for k, text in {**texts, 99: ""}.items():
        ids = model.whole.encode(text, add_special_tokens=False).ids + [1]
        own = sorted(pieces[k], key=lambda r: r["piece"])
        assert [r["start"] for r in own] == list(range(0, len(ids), 4096)) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    places = defaultdict(list)
    for r in rows:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in places.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 4096
    total = sum(r["length"] for r in rows)
    assert len(places) <= -(-total // 4096) + 1
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_equal_rows_spread(spark):
    df = documents(spark, [(None, None)] * 9000)
    rows = packing.pack(packing.token_pieces(df), group=1000).collect()
    fill = Counter(r["sequence_id"] for r in rows)
    assert len(rows) == 9000 and len(fill) == 3 and max(fill.values()) <= 4096 and all(r["gap"] >= 0 for r in rows)


def test_exchange_saves_bins(spark):
    rng = random.Random(6)
    rows = [(k, 0, 0, rng.randint(1, 4096), k) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    alone = packing.pack(df, group=40, rounds=0)
    mixed = packing.pack(df, group=40)
    assert mixed.count() == 600 and mixed.select("doc_id").distinct().count() == 600
    fill = {r["sequence_id"]: r["n"] for r in mixed.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()}
    assert max(fill.values()) <= 4096
    assert len(fill) <= alone.select("sequence_id").distinct().count()


# -- 5 -----------------------------------------------------------------------------------------------------------


def mix_by_hand(rows, weights=(5, 2, 1), share=1.5):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = defaultdict(int)
    for _, t, s in rows:
        total[s] += size(t)
    order = sorted(total, key=lambda s: (s is None, (s or "").encode()))
    w = {s: float(weights[k % 3]) for k, s in enumerate(order)}
    full = set()
    while True:
        left = [s for s in order if s not in full]
        level = (sum(total.values()) * share - sum(2 * total[s] for s in full)) / sum(w[s] for s in left) if left else 0
        more = {s for s in left if w[s] * level > 2 * total[s]}
        if not more:
            break
        full |= more
    target = {s: float(2 * total[s]) if s in full else w[s] * level for s in order}
    items, upto = [], defaultdict(int)
    for d, t, s in sorted(rows, key=lambda r: (hashlib.md5(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[0] is not None, r[0] or 0, size(r[1]))):
        upto[s] += size(t)
        h = hashlib.md5(f"42:{'' if d is None else d}".encode()).hexdigest()
        if size(t) and target[s]:
            items += [((upto[s] + p * total[s]) / target[s], "t" if s is None else "s" + s, p, h, -1 if d is None else d, size(t)) for p in (0, 1)]
    taken, run = Counter(), 0
    for item in sorted(items):
        run += item[-1]
        if run > min(sum(total.values()) * share, 2.0 * sum(total.values())):
            break
        taken[item[4]] += item[-1]
    return {d: (size(t), total[s], target[s], taken[-1 if d is None else d]) for d, t, s in rows}


@pytest.mark.parametrize("case", ["mixed", "one", "wordless"])
def test_mixing(spark, case):
    rng = random.Random(7)
    if case == "mixed":
        rows = [(k, "w " * rng.choice([0, 1, 3, 9, 40]), rng.choice(["a", "b", "é", "hot", "hot", "hot", "", None])) for k in range(300)] + [(None, "w\x0bx", "a")]
    elif case == "one":
        rows = [(1, "a b\x1cc  d", None)]
    else:
        rows = [(1, "", "a"), (2, None, "b"), (3, " \t", None)]
    df = documents(spark, [(d, t, None, s) for d, t, s in rows])
    got = {r["doc_id"]: tuple(r)[1:] for r in mixing.mix_sources(df).collect()}
    want = mix_by_hand(rows)
    assert {k: (v[0], v[1], pytest.approx(v[2]), v[3]) for k, v in want.items()} == got
    taken = mixing.take_mix(df)
    assert taken.columns == df.columns
    assert Counter(r["doc_id"] for r in taken.collect()) == Counter({k: v[3] // v[0] for k, v in want.items() if v[3]})
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_mixing_repeated_rows(spark):
    """Of a source that is one row again and again, as many rows are taken as its target asks for."""
    rows = [(1, "a b c", None, "s")] * 100 + [(2, "d e f", None, "s"), (2, "x y z", None, "s"), (2, "x y z", None, "t")] + [(k, "w " * 5, None, "t") for k in range(10, 40)]
    df = documents(spark, rows)
    told = mixing.mix_sources(df).collect()
    assert len(told) == len(rows)
    for size in {r["source_size"] for r in told}:
        own = [r for r in told if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 10
    got = Counter((r["doc_id"], r["text"]) for r in mixing.take_mix(df).collect())
    want = Counter()
    for r in told:
        want[r["doc_id"]] += r["taken"] // r["size"]
    by_id = Counter()
    for (k, _), n in got.items():
        by_id[k] += n
    assert by_id == +want


# -- 6 ------------------------------------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark):
    rng = random.Random(8)
    base = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(base)] * 3
    for _ in range(60):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2])):
            words[rng.randrange(300)] = "zz"
        texts.append(" ".join(words).upper())
    texts += ["", None, " \n", "one", "ONE", "É x", "é x"] + [" ".join(rng.choice(base) for _ in range(5)) for _ in range(40)]
    df = documents(spark, list(enumerate(texts)))
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(df).collect()}
    fps = {k: fingerprint_by_hand(t) for k, t in enumerate(texts)}
    pairs = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    comp = union_find(fps, pairs)
    assert got == {k: (f"{fps[k]:016x}", comp[k]) for k in fps}
    assert simhash.near_duplicates(df.limit(0)).count() == 0
    odd = documents(spark, [(None, "a b c"), (None, "a b c"), (5, "a b c"), (5, "a b c"), (None, "q")])
    assert Counter((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(odd).collect()) == {(None, 5): 2, (5, 5): 2, (None, None): 1}


@pytest.mark.parametrize("segments", [1, 4, 8, 16])
def test_close_pairs(spark, segments):
    rng = random.Random(9)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = sorted({c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for c in centres for _ in range(30)} | {0, 2**64 - 1, 1, 3})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    got = {(r["a"], r["b"]) for r in simhash.close_pairs(df, segments=segments).collect()}
    mask = 2**64 - 1
    assert got == {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 2}


def test_similar_documents(spark):
    rng = random.Random(10)
    rows, n = [], 0
    for _ in range(25):
        base = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(rng.choice([3, 40, 200]))]
        for _ in range(rng.randint(1, 4)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = "zz"
            rows.append((n, " ".join(words)))
            n += 1
    df = documents(spark, [*rows, (None, rows[0][1]), (900, ""), (901, None)])
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t else set() for k, t in [*rows, (900, ""), (901, "")]}
    like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
    comp = union_find(sets, [(a, b) for a in sets for b in sets if a < b and like(sets[a], sets[b]) >= 0.8])
    size = Counter(comp.values())
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert got == {k: c for k, c in comp.items() if size[c] > 1}
    kept = simhash.keep_one_of_each(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([*set(comp.values()), None])
    assert simhash.keep_one_of_each(df.limit(0)).count() == 0


def brute_components(rows):
    """Components of more than one document, by all pairs."""
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} for k, t in rows}
    comp = union_find(sets, [(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8])
    size = Counter(comp.values())
    return {k: c for k, c in comp.items() if size[c] > 1}


@pytest.mark.parametrize("case", ["template", "edited"])
def test_similar_in_large_groups(spark, case):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    rows = []
    if case == "template":  # 190 shingles of all and 24 of one's own make 0.798; two more in common make 0.81
        shared = [word() for _ in range(194)]
        for _ in range(150):
            start = [word(), word()]
            rows += [shared + start + [word() for _ in range(22)] for _ in range(2)]
    else:  # independent edits of one text: similar to some others only
        base = [word() for _ in range(200)]
        for _ in range(300):
            words = list(base)
            for _ in range(3):
                words[rng.randrange(5, 195)] = word()
            rows.append(words)
    rng.shuffle(rows)
    rows = [(k, " ".join(x)) for k, x in enumerate(rows)]
    want = brute_components(rows)
    assert want
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(documents(spark, rows)).collect()}
    assert got == want


def test_repeated_ids_lose_no_text(spark):
    rng = random.Random(16)
    text = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(80))
    a, b, c = text(), text(), text()
    rows = [(1, a), (5, a + " tail"), (5, b), (5, c), (5, c), (7, b + " tail"), (None, a)]
    df = documents(spark, rows)
    kept = Counter((r["doc_id"], r["text"]) for r in simhash.keep_one_of_each(df).collect())
    assert kept == {(1, a): 1, (5, b): 1, (5, c): 2, (None, a): 1}
    assert Counter((r["doc_id"], r["component_id"]) for r in simhash.similar_documents(df).collect()) == {(1, 1): 1, (5, 1): 1, (5, 5): 1, (7, 5): 1}


def test_sketches_lose_no_pair():
    rng = np.random.default_rng(17)
    for n in (60, 300, 5000):
        a, b = [], []
        for _ in range(400):
            shared = rng.integers(0, 2**64, int(n * 0.8), dtype=np.uint64)  # similarity 0.8
            parts = np.array_split(rng.integers(0, 2**64, n - len(shared), dtype=np.uint64), 2)
            a.append(simhash.sketch(np.unique(np.concatenate([shared, parts[0]]))))
            b.append(simhash.sketch(np.unique(np.concatenate([shared, parts[1]]))))
        assert simhash.may_be_similar(np.stack(a), np.stack(b), 0.8).all()
        assert not n > 100 or not simhash.may_be_similar(np.stack(a[1:]), np.stack(b[:-1]), 0.8).any()


def test_parities_lose_no_pair():
    rng = np.random.default_rng(18)
    for n in (5, 60, 900):
        for shared in (n, n - 1, int(n * 0.9), n // 2):
            both = rng.integers(0, 2**64, shared, dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 2**64, n - shared, dtype=np.uint64)])) for _ in range(2))
            differ = sum((int(x) ^ int(y)).bit_count() if (x < 0) == (y < 0) else 64 - (~int(x) ^ int(y)).bit_count() for x, y in zip(simhash.parities(a), simhash.parities(b)))
            assert differ <= len(np.setxor1d(a, b)) and (n > 60 or 2 * (n - shared) - differ <= 8)


def test_crowds_just_below_make_few_pairs(spark):
    """Edits of one text, of similarities of about 0.73: only pairs that may be similar become rows."""
    rng = random.Random(19)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(200)]
    rows = []
    for k in range(60):
        words = list(base)
        for _ in range(3):
            words[rng.randrange(5, 195)] = word()
        rows.append((k, k, " ".join(words)))
    rows += [(60 + k, 60 + k, rows[k][2] + " more") for k in range(3)]
    texts = spark.createDataFrame(rows, "id long, c long, text string")
    found = {(r["a"], r["b"]) for r in simhash._unlike_pairs(texts, "bigint", 5, 0.8).collect()}
    sets = {k: simhash.shingle_hashes(t, 5) for k, _, t in rows}
    like = {(a, b) for a in sets for b in sets if a > b and simhash.jaccard(sets[a], sets[b]) >= 0.8}
    assert {(60, 0), (61, 1), (62, 2)} <= like <= found and len(found) < len(like) + 60


def test_similar_short_texts(spark):
    rng = random.Random(12)
    rows = []
    for n in [8] * 40 + [9] * 40 + [13] * 40:  # the same text and one word more: 0.8, 0.83, 0.9
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n + 1)]
        rows += [words[:n], words]
    rows = [(k, " ".join(x)) for k, x in enumerate(rows)]
    want = brute_components(rows)
    assert len(want) == len(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(documents(spark, rows)).collect()}
    assert got == want


# -- 7 -------------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=1000))
def test_images_round_trip(raw):
    payload = media.padded(raw)
    assert payload.startswith(raw) and len(payload) % 192 == 0 and len(payload) >= 192 and set(payload[len(raw) :]) <= {32}
    stored = media.encode_png(payload)
    assert media.decode_png(stored) == payload
    with pytest.raises(ValueError):
        media.decode_png(stored[:40] + bytes([stored[40] ^ 1]) + stored[41:])


def read_png(raw):
    """The samples of an 8-bit image without interlace, by the format's own rules."""
    import struct

    assert raw.startswith(bytes([137, 80, 78, 71, 13, 10, 26, 10]))
    at, parts = 8, defaultdict(bytes)
    while at < len(raw):
        (n,) = struct.unpack_from(">I", raw, at)
        kind = raw[at + 4 : at + 8].decode()
        assert zlib.crc32(raw[at + 4 : at + 8 + n]) == struct.unpack_from(">I", raw, at + 8 + n)[0]
        parts[kind] += raw[at + 8 : at + 8 + n]
        at += n + 12
    wide, high, depth, colour, squeeze, filters, interlace = struct.unpack(">IIBBBBB", parts["IHDR"])
    per = {0: 1, 2: 3, 6: 4}[colour]
    assert (depth, squeeze, filters, interlace) == (8, 0, 0, 0)
    data, stride, out = zlib.decompress(parts["IDAT"]), wide * per, []
    before = bytes(stride)
    for y in range(high):
        kind, line = data[y * (stride + 1)], bytearray(data[y * (stride + 1) + 1 : (y + 1) * (stride + 1)])
        for x in range(stride):
            a, b = line[x - per] if x >= per else 0, before[x]
            c = before[x - per] if x >= per else 0
            p = a + b - c
            line[x] = (line[x] + [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]) % 256
        before = bytes(line)
        out.append(before)
    return b"".join(out)


def test_images_are_png(spark):
    df = documents(spark, [(1, "é" * 300), (2, ""), (3, "x" * 192)])
    stored = {r["digest"]: bytes(r["media"]) for r in media.stored_media(df).collect()}
    for text in ("é" * 300, "", "x" * 192):
        raw = text.encode()
        assert read_png(stored[hashlib.sha256(raw).hexdigest()]) == raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")


def test_items_stay_aligned(spark):
    a, b = "a" * 64, "b" * 64
    page = f"<p>one<!-- no --><br>two &amp; x</p><figure><img src='media:{a}' alt=alt><figcaption>said <b>so</b></figcaption></figure><script>var x='<p>'</script>three<img src=media:{b} alt='only alt'><img src=other.png>"
    items = media.parse_items(page)
    assert [(i["position"], i["kind"], i["text"], i["ref"], i["caption"]) for i in items] == [
        (0, "text", "one", None, None), (1, "text", "two & x", None, None), (2, "media", None, f"media:{a}", "said so"), (3, "text", "three", None, None), (4, "media", None, f"media:{b}", "only alt"), (5, "media", None, "other.png", None),
    ]
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    table = spark.createDataFrame([(a, 7)], "digest string, size long")
    got = sorted((r["doc_id"], r["position"], r["caption"], r["size"]) for r in media.resolve(media.interleaved(pages), table).collect() if r["position"] < 5)
    assert got == [(1, 2, "said so", 7), (1, 4, "only alt", None)]


def test_document_media(spark):
    texts = {1: "é" * 100, 2: "", 3: None, 4: "x" * 192, 5: "x" * 192, 6: "y" * 50_000}
    got = {r["doc_id"]: r for r in media.document_media(documents(spark, list(texts.items()))).collect()}
    for k, t in texts.items():
        raw = (t or "").encode()
        payload = media.padded(raw)
        stored = media.encode_png(payload)
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert (r["tail_crc32"], r["media_bytes"], r["media_sha256"]) == (zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest())
    assert tuple(got[4])[1:] == tuple(got[5])[1:] and tuple(got[2])[1:] == tuple(got[3])[1:]
    assert media.document_media(documents(spark, []).limit(0)).count() == 0


# -- 8 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def field():
    return pii.ChainField.train()


def test_base_patterns():
    text = "mail a.b+c@d-e.f.gh, x@y no 1.2.3.4 and 256.1.1.1 or 1.2.3.4.5 card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +1 (555) 010-9999 or +12 34"
    got = [(pii.KINDS[k], text[a:b]) for a, b, k in pii.base_spans(text)]
    assert got == [("email", "a.b+c@d-e.f.gh"), ("ip", "1.2.3.4"), ("ip", "1.2.3.4"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 010-9999")]


def plain_spans(text):
    """The contract's patterns as they stand."""
    digits = lambda x: re.sub("[^0-9]", "", x)
    luhn = lambda d: sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(d))) % 10 == 0
    found = [(m, 0) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m, 1) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [(m, 2) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [(m, 3) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return sorted((m.start(), m.end(), k) for m, k in found)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.c", "@", "x@y.z", ".", "%", "-", "1", "12", "0255", "256", " ", "+1", "(", ")", "4111 1111-1111 1111", "é", "\n"]), max_size=40).map("".join))
def test_patterns_in_linear_time_match(text):
    assert pii.base_spans(text) == plain_spans(text)


@pytest.mark.parametrize("text", ["7" * 50_000_000, "QUJD9+/x" * 6_000_000 + "@", "the river was low and " * 2_300_000], ids=["digits", "base64", "words"])
def test_very_long_texts(field, text):
    import resource
    import time

    began, held = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    assert pii.base_spans(text) == [] and all(k == 5 for _, _, k in pii.Finder(field).labelled([text])[0])
    assert time.time() - began < 90 and resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - held < 500_000


def test_blocks_change_nothing(field, monkeypatch):
    rng = random.Random(13)
    words = ["Mr. John Smith", "the", "password=ab12cd34ef", "Contact", "Maria", "Lopez,", "is", "SSN 123-45-6789", "Dr.", "Ab", "\n", "X1", 'token = "a9b8c7d6e5f4a1"']
    for _ in range(60):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 200)))
        want = pii.Finder(field).labelled([text])
        for size in (1, 20, 300):
            monkeypatch.setattr(pii.Finder, "BLOCK", size)
            assert pii.Finder(field).labelled([text]) == want
        monkeypatch.undo()


#: Sentences that the field has not seen, of other names, codes and words than its table.
HELD_OUT = """
I spoke to Mr. [name:Edward Nolan] yesterday .
Dr. [name:Ingrid Solberg] wrote the report .
Contact [name:Ahmed Farouk] before noon .
my name is [name:Wendy Chu] and I agree .
Frau [name:Helga Richter] kommt morgen .
Herr [name:Uwe Lindner], guten Tag .
je m'appelle [name:Paul Girard] .
me llamo [name:Lucia Navarro] .
signed by [name:Olga Smirnova] in Paris .
use password=[secret:qW3rty77zz] to enter
the api_key = [secret:"77ab10cd92ef33aa"] is old
token = [secret:"0f1e2d3c4b5a69788796a5b4c3d2e1f0"] expired
the key [secret:ZX81QL0PMN42VB7T] was lost
his SSN is [id:222-33-4444] .
IBAN [id:GB29NWBK60161331926819] was used
passport number [id:K7654321] is valid
They walked along the river in the evening .
Bread and butter cost 3 coins in 1850 .
Le train part de Lyon ce soir .
Die Katze liegt auf dem Sofa .
El sol sale por la mañana .
CLEARANCE!! EVERYTHING MUST GO!! call us
Visit the National Museum of Science today .
version 4.5.6 was released on 2021-03-04 .
"""


def test_field_on_unseen_sentences(field):
    right = wrong = missed = 0
    for line in HELD_OUT.strip().split("\n"):
        words, want = pii.ChainField.sequence(line)
        got = pii.Finder(field).labels([" ".join(words)])[0].tolist()
        right += sum(a == b != 0 for a, b in zip(got, want))
        wrong += sum(a != b and a != 0 for a, b in zip(got, want))
        missed += sum(a != b and b != 0 for a, b in zip(got, want))
    assert right / (right + wrong) > 0.9 and right / (right + missed) > 0.9, (right, wrong, missed)


def test_viterbi_in_batches(field):
    rng = np.random.default_rng(0)
    for _ in range(150):
        n = int(rng.integers(1, 30))
        e = rng.normal(0, rng.choice([1, 4, 12]), (n, len(pii.LABELS)))
        e[:, 0] += rng.choice([0, 10, 30])
        ends = np.unique(np.append(rng.integers(1, n + 1, 3), n))
        want = np.concatenate([field.viterbi(e[a:b]) for a, b in zip([0, *ends[:-1]], ends)])
        assert (field.decode(e, ends) == want).all()


def test_viterbi_is_best(field):
    rng = np.random.default_rng(1)
    for _ in range(20):
        e = rng.normal(0, 3, (4, len(pii.LABELS)))
        score = lambda p: field.first[p[0]] + field.last[p[-1]] + sum(e[i, k] for i, k in enumerate(p)) + sum(field.step[a, b] for a, b in zip(p, p[1:]))
        best = max(itertools.product(range(len(pii.LABELS)), repeat=4), key=score)
        assert tuple(field.viterbi(e)) == best


def test_personal_data(spark, field):
    texts = {
        1: "Contact Maria Stein for it. My mail is x@y.org and password=a1b2c3d4e5f6 there", 2: "The. And then it was. In London By By By.", 3: None, 4: "",
        5: "é😀 a@b.co", 6: "Dr. Anna Schmidt left\nDr. Paul Meyer, too. SSN 123-45-6789", 7: "the " * 30_000 + "1.2.3.4",
    }
    got = {r["doc_id"]: r for r in pii.find_personal_data(documents(spark, list(texts.items())), field).collect()}
    shown = {k: [(s.split(":")[0], (texts[k] or "")[int(s.split(":")[1]) : int(s.split(":")[2])]) for s in r["spans"].split(",") if s] for k, r in got.items()}
    assert shown[1] == [("name", "Maria Stein"), ("email", "x@y.org"), ("secret", "a1b2c3d4e5f6")]
    assert shown[2] == shown[3] == shown[4] == [] and shown[5] == [("email", "a@b.co")] and shown[7] == [("ip", "1.2.3.4")]
    assert shown[6] == [("name", "Anna Schmidt"), ("name", "Paul Meyer"), ("id", "123-45-6789")]
    assert got[1]["base_sha256"] == hashlib.sha256(b"email:39:46").hexdigest() and got[1]["n_email"] == 1 and got[4]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert pii.masked(texts[1], got[1]["spans"]).startswith("Contact <name> for it. My mail is <email> and password=<secret>")


# -- 9 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("digest", ["sha256", "weak"])
@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_exact_dedup(spark, digest, keep):
    rng = random.Random(11)
    rows = [(k, rng.choice(["a", "A", "b", "É", "é", "", None, "c" * 1000])) for k in range(60)] + [(3, "dup"), (3, "DUP"), (3, "dup"), (None, "b"), (None, "only null")]
    weak = lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 1))
    make = exact_dedup.sha256_digest if digest == "sha256" else lambda t: weak(t)
    df = documents(spark, rows)
    got = exact_dedup.exact_dedup(df, keep, digest=make).collect()
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    groups = defaultdict(list)
    for k, t in rows:
        groups[low(t)].append(k)
    pick = max if keep == "largest" else min
    best = {t: pick((k for k in ids if k is not None), default=None) for t, ids in groups.items()}
    want = Counter((k, best[low(t)], len(groups[low(t)])) for k, t in rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])
    assert exact_dedup.exact_dedup(df.limit(0)).count() == 0


def test_drop_exact_copies(spark):
    rows = [(1, "a"), (2, "A"), (3, "b"), (3, "b"), (None, "c"), (None, "C"), (4, None), (5, "")]
    df = documents(spark, rows)
    kept = exact_dedup.drop_exact_copies(df)
    assert kept.columns == df.columns
    assert Counter((r["doc_id"], (r["text"] or "").lower()) for r in kept.collect()) == {(2, "a"): 1, (3, "b"): 1, (None, "c"): 1, (5, ""): 1}
    assert exact_dedup.drop_exact_copies(df.limit(0)).count() == 0


def test_filters_spare_runs(spark):
    index = exact_dedup.MergeIndex(spark, memtable=10)
    index.flush(documents(spark, [(k, f"old {k}") for k in range(300)]))
    index.flush(documents(spark, [(1000 + k, f"new {k}") for k in range(300)]))
    assert index.compact().count() == 0 and index.read == []  # nothing is read but the filters
    index.flush(documents(spark, [(2000, "OLD 7"), (2001, "fresh"), (2002, "fresh")]))
    assert index.compact().count() == 2 and index.read == [0, 2]  # the second run's filter says no
    got = {r["id"]: (r["keep_id"], r["group_size"]) for r in index.verified().collect()}
    assert got[7] == got[2000] == (2000, 2) and got[2001] == (2002, 2) and got[1005] == (1005, 1) and len(got) == 603
    index.drop()


def test_levels_merge(spark):
    index, rng, rows = exact_dedup.MergeIndex(spark, "smallest", fanout=2), random.Random(3), []
    for k in range(5):
        new = [(100 * k + n, f"t{rng.randrange(60)}") for n in range(40)]
        index.flush(documents(spark, new))
        rows += new
    assert sorted(x.level for x in index.runs) == [0, 2]
    least = {}
    for k, t in rows:
        least[t] = min(k, least.get(t, k))
    assert {r["id"]: r["keep_id"] for r in index.verified().collect()} == {k: least[t] for k, t in rows}
    index.drop()


def test_runs_merge(spark):
    index = exact_dedup.MergeIndex(spark)
    index.flush(documents(spark, [(1, "a"), (2, "b")]))
    assert {r["id"]: r["kept"] for r in index.verified().collect()} == {1: True, 2: True}
    index.flush(documents(spark, [(3, "A"), (4, "c")]))
    assert {r["id"]: (r["keep_id"], r["kept"]) for r in index.verified().collect()} == {1: (3, False), 2: (2, True), 3: (3, True), 4: (4, True)}
    index.drop()


# -- 10 ---------------------------------------------------------------------------------------------------------------


def code_length(texts, order, x):
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        for k in range(order + 1):
            for i in range(k, len(t)):
                counts[k][t[i - k : i]][t[i]] += 1
    bits = 0.0
    for i in range(len(x)):
        k = min(i, order)
        while k >= 0:
            c = counts[k].get(x[i - k : i])
            if c:
                n, q = sum(c.values()), len(c)
                if x[i] in c:
                    bits -= math.log2(c[x[i]] / (n + q))
                    break
                bits -= math.log2(q / (n + q))
            k -= 1
        else:
            bits += 8
    return bits


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text("abcé ", max_size=30), min_size=1, max_size=4), st.lists(st.text("abcdé ", max_size=30), max_size=4), st.sampled_from([1, 3]))
def test_code_lengths(train, texts, order):
    own = {"x": [t.encode() for t in train], "y": [b"cab abc"]}
    model = langid.ContextTrees.train(own, order)
    model.compile()
    raw = [t.encode() for t in texts]
    got = model.lengths(raw) / langid.UNIT
    for t, row in zip(raw, got):
        assert row == pytest.approx([code_length(own["x"], order, t), code_length(own["y"], order, t)], abs=1e-2)


def test_long_texts_are_scored_in_blocks(monkeypatch):
    rng = random.Random(14)
    model = langid.ContextTrees.train({"x": [b"the cat sat"], "y": [b"le chat est"]})
    model.compile()
    texts = [bytes(rng.choice(b"the cats l\xc3") for _ in range(n)) for n in (0, 3, 50, 400, 1001)]
    want = model.lengths(texts)
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert (model.lengths(texts) == want).all()


def test_rare_languages_are_learnt(spark):
    rows = [(k, "the thing of and the rest", "en") for k in range(3000)] + [(5000 + k, "zażółć gęślą jaźń", "pl") for k in range(6)]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.language_id(documents(spark, rows)).collect()}
    assert got[5000] == got[5005] == "pl" and got[1] == "en"


def test_language_id(spark):
    rng = random.Random(12)
    words = {"en": ["the", "and", "of", "thing"], "de": ["und", "nicht", "über", "das"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(15)), lang) for k in range(200) for lang in [rng.choice(["en", "de"])]]
    df = documents(spark, [*rows, (900, None, "en"), (901, "123 !?", "en"), (902, "", None), (None, "the thing of", "en"), (903, "und das " * 9000, None)])
    got = {r["doc_id"]: r for r in langid.language_id(df).collect()}
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 3 == 1) for k, _, _ in rows) and not got[None]["held_out"]
    assert np.mean([got[k]["lang_pred"] == lang for k, _, lang in rows if got[k]["held_out"]]) > 0.98
    assert [got[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3 and got[None]["lang_pred"] == "en" and got[903]["lang_pred"] == "de"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in langid.language_id(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.language_id(df.limit(0)).count() == 0
