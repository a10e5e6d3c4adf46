"""The corpus pipeline and the registered queries, over small tables."""

import sys
from collections import Counter, defaultdict
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents of good and bad texts, exact and near copies, and their labels."""
    import random

    rng = random.Random(1)
    syllables = ["th", "er", "on", "an", "re", "in"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for k in range(160):
        words = [word() for _ in range(80)]
        bad = k % 5 == 0
        text = " ".join(w + "%%%" for w in words) if bad else (" ".join(words) + ".").capitalize()
        rows.append((k, text, "en", f"s{k % 4}", len(text)))
        labels.append((k, int(not bad), 0))
    rows += [(1000 + k, rows[k][1].upper() if k % 2 else rows[k][1], "en", "s0", 1) for k in (1, 2, 3)]
    near = rows[7][1].split()
    near[40] = "zz"
    rows.append((2000, " ".join(near), "en", "s1", 1))
    where = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return str(where)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, tables)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
        docs = spark.createDataFrame(out.collect(), out.schema)
        seen[name] = docs
    ids = {name: Counter(r["doc_id"] for r in df.collect()) for name, df in seen.items()}
    assert not any(k % 5 == 0 for k in ids["quality classifier"] if k < 1000) and len(ids["quality classifier"]) == 132
    assert ids["exact dedup"].keys() == ids["quality classifier"].keys() - {1, 2, 3}
    assert ids["SimHash near-dedup"].keys() == ids["exact dedup"].keys() - {2000}
    mixed = ids["mixing sources"]
    assert mixed.keys() <= ids["SimHash near-dedup"].keys() and set(mixed.values()) <= {1, 2}
    packed = seen["best-fit packing"].collect()
    pieces = Counter(r["doc_id"] for r in packed if r["piece"] == 0)
    assert pieces == mixed
    fill = defaultdict(int)
    for r in packed:
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 4096 and len(fill) <= sum(fill.values()) // 4096 + 2


def test_near_copies_link_close_fingerprints(spark):
    """Texts that mostly repeat one passage have fingerprints alike and shingle sets unlike; they link, and links of both kinds go on."""
    import random

    from corpusmill.llm.simhash import jaccard, near_duplicates, shingle_hashes

    rng = random.Random(20)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    passage, own = [word() for _ in range(11)], [[word() for _ in range(40)] for _ in range(4)]
    one, two, far = (" ".join(passage * 60 + x) for x in own[:3])
    texts = {1: one, 2: two, 3: two + " " + word(), 4: " ".join(own[3]), 5: " ".join(reversed(far.split()))}
    df = spark.createDataFrame([(k, t, "en", "a", 1) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    sets = {k: shingle_hashes(t, 5) for k, t in texts.items()}
    assert jaccard(sets[1], sets[2]) < 0.5 < 0.8 <= jaccard(sets[2], sets[3])
    by_bits = {r["doc_id"]: r["component_id"] for r in near_duplicates(df).collect()}
    assert by_bits[1] == by_bits[2] == 1 and by_bits[4] == 4 and by_bits[5] == 5
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_copies(spark, df, "").collect()) == [1, 4, 5]


def test_run(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)


def test_sql_of_operators(spark, tables):
    duckdb = pytest.importorskip("duckdb")
    from corpusmill.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tables}/documents.parquet/*.parquet'")
    for name in ("op5_mix_sources", "op9_exact_dedup"):
        df = QUERIES[name](spark, tables)
        names = sorted(df.columns)
        got = Counter(tuple(r) for r in df.select(*[F.col(c) for c in names]).collect())
        want = Counter(con.sql(f"SELECT {', '.join(names)} FROM ({ORACLE_SQL[name]})").fetchall())
        assert got == want


def test_url_sql_and_union_find_agree_on_edges(spark, tmp_path):
    """Chains, a hub, allows within blocked components, targets that aren't pages, and all forms of links."""
    import random

    duckdb = pytest.importorskip("duckdb")
    from corpusmill.llm import url_filters
    from corpusmill.llm.queries import ORACLE_SQL, QUERIES, URL_RULES

    rng = random.Random(4)
    hosts = ["a.com", "b.io", "www.example.com", "x.net", "example.net", "c.org", "D.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice('789')}{k}" for k in range(150)]
    forms = [
        '<link rel="canonical" href="{}">', "<LINK href='{}' rel='alternate canonical'/>", "<link rel=canonical href={}>", '<meta http-equiv="refresh" content="0; url={}">',
        "<meta content='5;URL={}' http-equiv=Refresh>", '<!-- <link rel="canonical" href="{}"> -->', '<script>"<link rel=canonical href={}>"</script>', '<link rel="stylesheet" href="{}">',
    ]
    rows = []
    for k, url in enumerate(urls):
        target = rng.choice([urls[k - 1], urls[0], rng.choice(urls), "http://elsewhere.org/es/1", "http://elsewhere.io/q", "/fr/1", "../x", "?p=1&amp;q=2", "#top", "//b.io/fr/7", "mailto:x@y", ""])
        rows.append((k, url, rng.choice(forms).format(target) if rng.random() < 0.6 else None))
    rows += [(200 + k, f"http://chain{k}.io/", f'<link rel="canonical" href="http://chain{k + 1}.io/">') for k in range(30)] + [(230, "http://chain30.io", '<link rel="canonical" href="http://z.org/es/">')]
    rows += [(300 + k, f"http://leaf{k}.io/", '<link rel="canonical" href="http://hub.com/en/">') for k in range(40)] + [(400, None, "x"), (401, "none", forms[0].format("http://c.org/es/1")), (402, urls[3], "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: tuple(r) for r in QUERIES["op1_url_filters"](spark, str(tmp_path)).select("page_id", "host", "path", "rule", "verdict", "blocked_alias").collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == {r[0]: r for r in con.sql(f"SELECT page_id, host, path, rule, verdict, blocked_alias FROM ({ORACLE_SQL['op1_url_filters']})").fetchall()}
    # the same by union-find over the operator's own links
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    ends = df.select("page_id", "url", url_filters.alias_key(F.col("url")).alias("k"), F.explode_outer(url_filters.link_targets(F.col("url"), F.col("html"))).alias("b"))
    ends = ends.select("page_id", "url", "k", "b", url_filters.alias_key(F.col("b")).alias("v"), *[url_filters.longest_rule(url_filters.url_host(F.col(c)), url_filters.url_path(F.col(c)), URL_RULES)["verdict"].alias(n) for c, n in (("url", "own"), ("b", "theirs"))]).collect()
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    edges = [r for r in ends if r["k"] and r["v"] and r["k"] != r["v"]]
    for r in edges:
        up[root(r["k"])] = root(r["v"])
    bad = {root(r[k]) for r in edges for k, who in (("k", "own"), ("v", "theirs")) if r[who] == "block"}
    want = {r["page_id"]: r["own"] or ("block" if r["k"] in up and root(r["k"]) in bad else "allow") for r in ends}
    assert {k: r[4] for k, r in got.items()} == want
    assert sum(r[5] for r in got.values()) > 60 and any(r[5] and r[4] == "allow" for r in got.values())


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, repeated rows, a clashing extra column; and an empty table."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    text = "Some words that are here for the run. " * 20
    rows = [(1, text, "en", "a", 5, "x"), (1, text, "en", "a", 5, "x"), (None, text + "more", None, None, None, None), (2, None, None, "a", None, "y"), (3, "", "en", None, 0, "z"), (4, text.upper(), "en", "b", 7, None), (None, None, None, None, None, None)]
    labels = spark.createDataFrame([(1, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, own in (("odd", rows), ("empty", [])):
        spark.createDataFrame(own, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.write.parquet(f"{tmp_path}/{name}/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/odd").collect()
    assert {r["doc_id"] for r in out} <= {1, 4, None} and out and all(r["length"] <= 4096 for r in out)
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").count() == 0


def test_batches_of_texts_are_bounded(spark):
    """Long texts reach Python a few MB at a time, not 10,000 rows: 24 MB are several batches."""
    import pyarrow as pa

    from corpusmill.llm.common import BATCH_BYTES, map_batches

    def told(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    docs = spark.range(0, 400, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcde "), 10_000).alias("text"))
    sizes = map_batches(docs, told, "n long, size long").collect()
    assert sum(r["n"] for r in sizes) == 400 and max(r["size"] for r in sizes) < 2 * BATCH_BYTES


def test_components_end_with_the_last_change(spark):
    """Stars need one look at each node, not rounds that change nothing, and no table of a round stays in the shared folder."""
    import os

    from corpusmill.llm.common import shared_dir
    from corpusmill.llm.components import connected_components

    sc, where = spark.sparkContext, f"{shared_dir(spark).removeprefix('file://')}/corpusmill"
    there = lambda: set(os.listdir(where)) if os.path.isdir(where) else set()
    before, cases = there(), {"stars": [(k, k // 10 * 10) for k in range(100)], "path": [(k, k + 1) for k in range(64)] + [(7, 100), (200, 100), (5, None), (9, 9)]}
    jobs = {}
    for name, edges in cases.items():
        sc.setJobGroup(name, name)
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        jobs[name] = len(sc.statusTracker().getJobIdsForGroup(name))
        assert got == ({k: k // 10 * 10 for k in range(100)} if name == "stars" else {k: 0 for k in [*range(65), 100, 200]})
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert jobs["stars"] <= 12 and there() == before
