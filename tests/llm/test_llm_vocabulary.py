"""Spelling variants, the hash-prefix forest and the divergence of sources against plain versions and defined edge cases."""

import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import divergence, hash_forest, spelling

DOCS = "doc_id long, text string, lang string, source string"


def documents(spark, rows, parts=3):
    """Rows (doc_id, text[, lang, source]) with extra columns whose names the operators use themselves."""
    full = [(*r, *[None] * (4 - len(r))) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumns({c: F.lit(1) for c in ("n", "word", "term", "block", "slice", "total")}).repartition(parts)


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


# -- 11 -----------------------------------------------------------------------------------------------


def plain_spelling(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}
    near, gaps = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            gaps[w[:i], w[i + 1 :]].append(w)
            if (d := w[:i] + w[i + 1 :]) in words:
                near[w].add(d), near[d].add(w)
    for group in gaps.values():
        for a, b in itertools.permutations(group, 2):
            near[a].add(b)
    form = {}
    for w in words:
        if near[w] and words[best := min(near[w], key=lambda x: (-words[x], x))] >= 2 * words[w]:
            form[w] = best
    out = {}
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out[w] = (form.get(w), root, words[w], len(near[w]), words.get(form.get(w)))
    return out


def spelled(df):
    rows = spelling.spelling_variants(df).collect()
    assert len({r["word"] for r in rows}) == len(rows)
    return {r["word"]: tuple(r)[1:] for r in rows}


def test_spelling_against_plain(spark):
    rng = random.Random(3)
    # few letters and equal neighbours: many near words, and edits that two places can tell of
    words = ["".join(rng.choice("aabÀß") for _ in range(rng.randrange(4, 9))) for _ in range(400)]
    words += ["Straße", "straBe", "strasse", "strase", "étagère", "Étagère", "aaaaa", "aaaaaa", "aaaaaaa"]
    docs = [(k, " ".join(rng.choice(words) if rng.random() < 0.6 else words[int(rng.random() ** 3 * len(words))] for _ in range(300)) + "×÷1-") for k in range(60)]
    docs += [(None, "hello hello helo!"), (7, None), (8, ""), (9, "hallo\x00hello" * 3), *[(61, "repeated repeatd rows")] * 4, (62, "chainx " * 4 + "chainxy " * 9 + "chainxyz " * 20), (10**15, "ÀÀÀÀÀ" * 3 + " 12")]
    want = plain_spelling(docs)
    assert any(r[0] and r[1] != r[0] for r in want.values())  # some chain has two steps
    assert spelled(documents(spark, docs)) == want
    assert spelled(documents(spark, docs[:1]).limit(0)) == {}


def test_spelling_of_long_texts_and_runs(spark):
    rng = random.Random(4)
    run = "".join(rng.choice("acgt") for _ in range(60_000))
    other = run[:40_000] + ("a" if run[40_000] != "a" else "c") + run[40_001:]
    less, more = run[:100] + run[101:], run[:59_000] + "g" + run[59_000:]
    plenty = "lorem ipsum dolor " * 150_000  # 2.7 MB, several blocks
    docs = [(k, " ".join([run, run, other, less, more])) for k in range(4)] + [(5, plenty), (6, "lorems lorems lorems " + run)]
    got, want = spelled(documents(spark, docs)), plain_spelling(docs)
    assert got == want and got[other][0] == got[less][0] == got[more][0] == run and got["lorems"][0] == "lorem"


def test_blocks_cut_no_run():
    text = "abc " * 1000 + "x" * 5000 + " é" * 500
    parts = list(spelling.blocks(text, 64))
    assert "".join(parts) == text and len(parts) > 10
    assert Counter(r for p in parts for r in spelling.RUN.findall(p)) == Counter(spelling.RUN.findall(text))


def test_hashed_candidates_equal_literal_ones():
    rng = random.Random(6)
    for _ in range(200):
        word = "".join(rng.choice("abé") for _ in range(rng.randrange(5, 12)))
        known = {"".join(rng.choice("abé") for _ in range(len(word) + rng.choice([-1, 0, 1]))) for _ in range(2000)} | {word}
        lo = len(word) // 2
        for places, gaps in ((range(lo), range(lo)), (range(lo, len(word)), range(lo, len(word) + 1))):
            assert spelling._long_hits(word, places, gaps, ["a", "b", "é"], known) - {word} == spelling._hits(word, places, gaps, ["a", "b", "é"], known) - {word}


# -- 12 -----------------------------------------------------------------------------------------------


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumns({c: F.lit(1) for c in ("id", "v", "tree", "hash", "n")}).repartition(3)


def plain_nearest(rows, k):
    """The k nearest of each query, and all scores."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    out = {}
    for q in np.nonzero(ids % 20 == 0)[0]:
        s = (x * x[q]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != q][:k]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def searched(df, k=20, **more):
    out = defaultdict(list)
    for r in hash_forest.nearest(df, df.where("vec_id % 20 = 0"), k, **more).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    for q in out:
        out[q].sort()
        assert [r[0] for r in out[q]] == list(range(1, len(out[q]) + 1)) and all(r[1] != q for r in out[q])
        assert [r[1:] for r in out[q]] == sorted((r[1:] for r in out[q]), key=lambda r: (-r[1], r[0]))
    return out


def recall(got, want):
    return sum(len({r[1] for r in got[q]} & {r[0] for r in near}) for q, near in want.items()) / sum(map(len, want.values()))


def test_forest_recall(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 24)) * rng.uniform(0.2, 3, size=(3000, 1))  # lengths differ: largest products aren't smallest angles
    rows = [(k, [float(v) for v in np.float32(r)]) for k, r in enumerate(x)]
    want = plain_nearest(rows, 20)
    got = searched(vectors(spark, rows), bucket=256)
    assert recall(got, want) >= 0.9
    score = {(q, i): s for q, i, s in ((q, r[1], r[2]) for q in got for r in got[q])}
    exact = {r[0]: np.array(r[1], float) for r in rows}
    assert all(abs(s - exact[q] @ exact[i]) < 1e-9 for (q, i), s in score.items())


def test_forest_goes_up_and_splits(spark):
    """Tight clusters of very different sizes: a small one's buckets hold too little and its queries go up; a large one's are cut into blocks."""
    rng = np.random.default_rng(9)
    heart = rng.normal(size=(2, 8)) * 5
    x = np.concatenate([heart[0] + rng.normal(size=(4000, 8)) * 0.01, heart[1] + rng.normal(size=(3, 8)) * 0.01])
    rows = [(k * 5, [float(v) for v in r]) for k, r in enumerate(x)]
    few = [rows[k] for k in (0, 4, 8, 4000)]
    df = vectors(spark, rows, "double")
    got = defaultdict(set)
    for r in hash_forest.nearest(df, df.where(F.col("vec_id").isin([r[0] for r in few])), 2, bucket=16, many=0.02, grows=1.0).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert all(len(got[r[0]]) == 2 for r in few)
    assert got[20_000] == {20_005, 20_010}


def test_forest_ties_and_odd_vectors(spark):
    rng = random.Random(2)
    rows = [(k, [float(rng.randrange(-1, 2)) for _ in range(4)] ) for k in range(300)]
    rows += [(1000 + k, [1.0, 1.0, 0.0, 1.0]) for k in range(200)]  # a large group of equal vectors, with queries in it
    fine = [r for r in rows if any(r[1])]
    odd = [(2000, None), (2020, [0.0] * 4), (2040, [1.0, None, 1.0, 1.0]), (2060, [float("nan")] * 4), (2080, [float("inf"), 0.0, 0.0, 0.0]), (2100, [1.0] * 5), (None, [9.0] * 4), (2120, [])]
    got = searched(vectors(spark, rows + odd + fine[:30]), many=100.0)  # all rows are candidates: exact
    assert {q: [r[1:] for r in near] for q, near in got.items()} == plain_nearest(fine, 20)
    four = [(20, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [-1.0, 0.0]), (3, [1.0, 0.0])]
    assert searched(vectors(spark, four)) == {20: [(1, 3, 1.0), (2, 1, 0.0), (3, 2, -1.0)]}  # all there are
    assert searched(vectors(spark, odd)) == {}
    assert searched(vectors(spark, rows).limit(0)) == {}


# -- 13 ------------------------------------------------------------------------------------------------


def plain_divergence(docs, least=30, top=50):
    docs = [tuple(x or "" for x in d[1:]) for d in docs]
    within, count, sources = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        terms = [lowered(t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)]
        within[lang].update(set(terms)), count[lang].update(terms), count[lang, source].update(terms), sources[lang].add(source)
    out = []
    for lang, names in sources.items():
        kept = sorted((t for t, n in within[lang].items() if n >= least), key=str.encode)

        def shares(c):
            total = sum(c[t] for t in kept)  # noqa: B023
            return [1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept]  # noqa: B023

        p, q = {s: shares(count[lang, s]) for s in names}, shares(count[lang])
        for s in names:
            apart = sorted(((-sum(abs(a - b) for a, b in zip(p[s], p[o])), o.encode()) for o in names if o != s))
            out += [(lang, s, "pair", o.decode(), -v, r) for r, (v, o) in enumerate(apart, 1)]
            gains = sorted((b - a, t.encode()) for a, b, t in zip(p[s], q, kept) if count[lang, s][t] and a > b)[:top]
            out += [(lang, s, "term", t.decode(), -v, r) for r, (v, t) in enumerate(gains, 1)]
    return sorted(out)


def made_documents(rng, n, sources):
    terms = ["".join(rng.choice("abcdé√ß") for _ in range(rng.randrange(1, 4))) for _ in range(150)]
    rows = []
    for k in range(n):
        source = rng.choice(sources)
        text = " ".join(terms[int(rng.random() ** 2 * len(terms))] + rng.choice(["", "1", "A_", "\x00"]) for _ in range(rng.randrange(60)))
        rows.append((k, text, rng.choice(["de", "de", "en", None, ""]), source))
    return rows


def test_divergence_against_plain(spark):
    rng = random.Random(11)
    docs = made_documents(rng, 500, ["hot"] * 20 + [f"s{k}" for k in range(23)] + [None, ""])
    docs += [(900, None, "de", "silent"), (901, "lone words", "xx", "a"), (902, "", "xx", "b"), (903, "", "yy", "only")] + [docs[0]] * 3
    df, want = documents(spark, docs), plain_divergence(docs)
    assert sorted(map(tuple, divergence.source_divergence(df).collect())) == want
    # several slices, an even and an odd number of blocks, several jobs
    assert sorted(map(tuple, divergence.source_divergence(df, slice_terms=20, block_sources=3, rounds=2).collect())) == want
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_residents_are_not_moved(spark):
    """A cogroup by the resident table's keys has an exchange for the other side alone."""
    from corpusmill.llm.common import resident

    df = spark.range(100).select((F.col("id") % 7).alias("a"), "id")
    home, guests = resident(df, "a"), df.toDF("a", "g")
    met = home.groupBy("a").cogroup(guests.groupBy("a")).applyInArrow(lambda key, x, y: x.select(["id"]), "id long")
    assert met._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1 and met.count() == 100


def test_divergence_top_and_large_counts(spark):
    docs = [(k, "aa " * (3 if k % 2 else 1) + "bb cc dd ee", "de", f"s{k % 2}") for k in range(70)]
    got = sorted(map(tuple, divergence.source_divergence(documents(spark, docs), top=1).collect()))
    assert got == plain_divergence(docs, top=1)
    big = np.array([0, 1 << 40, (1 << 62) - 9], np.int64)
    assert divergence._shares(big, 1 << 62, 3).tolist() == [1 + 10**9 * (int(x) + 5) // ((1 << 62) + 15) for x in big]


def test_tournament_meets_once():
    """Every two blocks meet once, with the formula evaluated on whole numbers."""
    for blocks in (2, 4, 10):
        met = Counter()
        for r in range(blocks - 1):
            partner = {b: (r if b == blocks - 1 else blocks - 1 if b == r else (2 * r - b) % (blocks - 1)) for b in range(blocks)}
            assert all(partner[partner[b]] == b != partner[b] for b in partner)
            met.update(frozenset((b, partner[b])) for b in partner)
        assert met == Counter({frozenset(p): 2 for p in itertools.combinations(range(blocks), 2)})
