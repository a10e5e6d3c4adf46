"""Near-duplicate detection by SimHash, with a segment-popcount embedding to find close fingerprints.

A 64-bit fingerprint is cut into segments; the vector of their bit counts is its embedding. Two
fingerprints' Manhattan distance in the embedding is a lower bound of their Hamming distance, so
those that differ in at most two bits lie within Manhattan distance two. The range join runs over
the unit grid: each fingerprint is written to its own cell and the cells one step away, and two
vectors within distance two always share such a cell. The fingerprints that meet in a cell are then
compared exactly.

Bit counts alone tell little, so cells get a second key. Of three blocks of bits, two bits of
difference leave one the same at least; for each block the grid is laid over the other bits, and a cell
holds only fingerprints that agree in the block. Random fingerprints then meet about as often as 31
equal bits would let them, so the join grows with the links, not with the square of the table.

Equal fingerprints are one node before anything is joined, so copies make no pairs. Links between
different fingerprints are few: within two bits of one there are 2080 others at most.
"""

from __future__ import annotations

from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, map_batches, portions, small
from corpusmill.llm.components import connected_components

SEED = 42
MAX_BITS = 2


def fingerprint(text: str | None, shingle: int) -> int:
    """The unsigned SimHash of one text: a bit is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - shingle + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # bounded memory for long texts
        counts += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def _fingerprint_batches(batches, shingle):
    for batch in batches:
        texts = batch.column(1)
        values = np.fromiter((fingerprint(x.as_py(), shingle) for x in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    return map_batches(two, partial(_fingerprint_batches, shingle=shingle), f"doc_id {kind}, fp long")


def _grid(bits: Column, wide: int, segments: int) -> list[Column]:
    """The own cell and those one step away of the lowest ``wide`` bits, cut into segments; null where a step leaves the grid."""
    width = -(-wide // segments)
    size = width.bit_length()  # bits that hold a count from 0 to width
    widths = [min(width, wide - width * k) for k in range(segments) if wide > width * k]
    counts = [F.bit_count(F.shiftrightunsigned(bits, width * k).bitwiseAND(F.lit((1 << w) - 1))).cast("long") for k, w in enumerate(widths)]
    own = counts[0]
    for k, x in enumerate(counts[1:], 1):
        own = own + F.shiftleft(x, size * k)
    up = [F.when(x < w, own + F.lit(1 << size * k)) for k, (x, w) in enumerate(zip(counts, widths))]
    return [own, *up, *[F.when(x > 0, own - F.lit(1 << size * k)) for k, x in enumerate(counts)]]


def _cells(fp: Column, segments: int) -> Column:
    """The keys under which a fingerprint is compared: for each of three blocks, its bits and the grid cells of all others."""
    room = segments * (-(-43 // segments)).bit_length()
    low, mid = F.lit((1 << 21) - 1), F.lit((1 << 42) - 1)
    rest = [F.shiftrightunsigned(fp, 21), fp.bitwiseAND(low).bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 42), 21)), fp.bitwiseAND(mid)]
    block = [fp.bitwiseAND(low), F.shiftrightunsigned(fp, 21).bitwiseAND(low), F.shiftrightunsigned(fp, 42)]
    cells = []
    for k, (own, others) in enumerate(zip(block, rest)):
        head = F.shiftleft(own + F.lit(k << 22), room)
        cells += [head + x for x in _grid(others, 42 if k == 2 else 43, segments)]
    return F.filter(F.array(*cells), lambda c: c.isNotNull())


def close_pairs(nodes: DataFrame, max_bits: int = MAX_BITS, segments: int = 4) -> DataFrame:
    """Pairs (a, b), a < b, of the distinct longs in column fp that differ in at most ``max_bits`` (0 to 2) bits."""
    if not 0 <= max_bits <= 2 or not 1 <= segments <= 19:
        raise ValueError("max_bits is 0 to 2; there are 1 to 19 segments, so that their counts fit beside a block")
    cells = nodes.select("fp", F.explode(_cells(F.col("fp"), segments)).alias("cell"))
    a, b = cells.select(F.col("fp").alias("a"), "cell"), cells.select(F.col("fp").alias("b"), "cell")
    close = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
    return a.hint("merge").join(b, (a["cell"] == b["cell"]) & close).select("a", "b").distinct()


def _nodes(own: DataFrame) -> DataFrame:
    """fp and the least doc_id of each different fingerprint."""
    # a node becomes many rows, so nodes are spread wider than their own size asks for
    parts = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")).repartition(parts, "fp"))


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = MAX_BITS, segments: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document.

    component_id is the smallest doc_id that links reach. A text of fewer words than a shingle has is
    one shingle; null and wordless texts have fingerprint zero and link like any other. Null doc_ids
    are ignored as component ids unless a component has no other. Repeated rows stay. An empty table
    gives an empty table; no other column is read.
    """
    own = cut(fingerprints(docs, shingle, id_col, text_col))
    nodes = _nodes(own)
    found = connected_components(close_pairs(nodes, max_bits, segments), "a", "b")
    of = nodes.join(found, nodes["fp"] == found["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = of.groupBy("component").agg(F.min("least").alias("component_id"))
    named = cut(of.join(ids, "component").select("fp", "component_id"))
    return own.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# -- similarity of shingle sets ---------------------------------------------------------------------
#
# A fingerprint of a whole text can't tell a similarity of 0.8 from chance by two bits: such texts
# differ in about ten. So for a threshold a text gets one fingerprint for each of ``tables``, each over
# the few shingles that come first in the table's order. Similar texts have the same few in some
# table (at 0.8 in one of 20 at least with probability 0.9996), so equal fingerprints of a table make
# candidates. Sketches of the shingle sets drop those that are far from similar, and the whole sets of
# the others are then compared exactly.

#: Bytes of an id in a join, bins of a sketch, and longs of parities.
ID_BYTES, BINS, PARITIES = 64, 256, 16
#: Of texts with up to so many different shingles the tables take much the same ones, so they miss too much.
FEW = 40


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, len(words) - shingle + 1))


def table_fingerprints(hashes: np.ndarray, tables: int, first: int) -> np.ndarray:
    """A SimHash for each table, of the ``first`` hashes in the table's order (all, if there are fewer)."""
    if not len(hashes):
        return np.zeros(tables, np.uint64)
    n = min(first, len(hashes))
    picked = np.empty((tables, n), np.uint64)
    for k in range(tables):
        order = (hashes ^ np.uint64(0x9E3779B97F4A7C15 * (k + 1) & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xD1342543DE82EF95 + 2 * k)
        order ^= order >> np.uint64(32)
        order *= np.uint64(0xC4CEB9FE1A85EC53)
        picked[k] = hashes[np.argpartition(order, n - 1)[:n]]
    bits = np.unpackbits(picked.view(np.uint8).reshape(tables, n, 8), axis=2, bitorder="little").sum(axis=1)
    return np.packbits(2 * bits > n, axis=1, bitorder="little").view(np.uint64).ravel()


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted sets of hashes; two empty ones are the same."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A byte for each of BINS ranges of hashes: of the least hash in it, 0 where there is none. hashes: sorted."""
    out = np.zeros(BINS, np.uint8)
    if len(hashes):
        own = (hashes >> np.uint64(56)).astype(np.int64)  # BINS is 256
        first = np.flatnonzero(np.diff(own, prepend=-1))
        out[own[first]] = 1 + (hashes[first] % np.uint64(255)).astype(np.uint8)
    return out


def may_be_similar(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """Which pairs of sketches (rows) may come from sets of a similarity of ``least``.

    Of the bins that either has, similar sets agree in that share, give or take; pairs five standard
    deviations below it are told to be unlike.
    """
    held = ((a > 0) | (b > 0)).sum(axis=1)
    same = ((a == b) & (a > 0)).sum(axis=1)
    return same >= least * held - 5 * np.sqrt(least * (1 - least) * held)


def parities(hashes: np.ndarray) -> np.ndarray:
    """A bit for each of 64 * PARITIES ranges of hashes: whether an odd number lies in it, as signed longs.

    What one of two sets has alone turns one bit, so they differ by as many hashes as bits at least.
    """
    odd = np.bincount((hashes >> np.uint64(54)).astype(np.int64), minlength=64 * PARITIES) & 1  # 2 ** 10 ranges
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _table_batches(batches, shingle, tables, first):
    for batch in portions(batches, 1):
        sets = [shingle_hashes(x.as_py(), shingle) for x in batch.column(1)]
        values = [table_fingerprints(x, tables, first).view(np.int64) for x in sets]
        flat = pa.array(np.concatenate(values) if values else np.zeros(0, np.int64))
        ends = pa.array(np.arange(len(values) + 1) * tables, pa.int32())
        sketches = pa.array([sketch(x).tobytes() for x in sets], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.ListArray.from_arrays(ends, flat), sketches], names=["id", "n", "fps", "sketch"])


def _likely_batches(batches, least):
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, BINS) for k in (2, 3))
        good = pa.array(may_be_similar(x, y, least), pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(k).filter(good) for k in (0, 1)], names=["a", "b"])


def _verify_batches(batches, shingle, least):
    for batch in portions(batches, 2):
        a, b, x, y = (batch.column(k) for k in range(4))
        seen: dict[str, np.ndarray] = {}

        def hashes(text: str, seen: dict = seen) -> np.ndarray:
            if text not in seen:
                if len(seen) > 200:
                    seen.clear()
                seen[text] = shingle_hashes(text, shingle)
            return seen[text]

        good = pa.array([jaccard(hashes(p.as_py() or ""), hashes(q.as_py() or "")) >= least for p, q in zip(x, y)], pa.bool_())
        yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], names=["a", "b"])


def _set_batches(batches, shingle):
    for batch in portions(batches, 2):
        sets = [shingle_hashes(x.as_py(), shingle).view(np.int64) for x in batch.column(2)]
        flat = pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64))
        sizes = np.array([len(x) for x in sets], np.int64)
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        odd = pa.array([parities(x.view(np.uint64)) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes), pa.ListArray.from_arrays(ends, flat), odd], names=["id", "c", "n", "hs", "odd"])


def _unlike_pairs(texts: DataFrame, kind: str, shingle: int, least: float) -> DataFrame:
    """Pairs (a, b), a > b, of texts of different components c that may be similar; none that is gets lost.

    Sets of a similarity of ``least`` share one of the first n - ceil(least n) + 1 shingles in any
    common order, and the first they share lies so early in both that the needed overlap still fits. The
    rarest come first, so a passage of many texts makes pairs only of those that hardly have anything
    else, and edits of one text only of those that share an edit or have few of their own. Of pairs that
    share one, those whose parities differ by more than similar sets may are left out where they meet, so a
    crowd of texts just under ``least`` makes few rows.
    """
    sets = cut(map_batches(texts, partial(_set_batches, shingle=shingle), f"id {kind}, c {kind}, n long, hs array<long>, odd array<long>"))
    flat = cut(sets.withColumn("r", F.monotonically_increasing_id()).select("r", "id", "c", "n", F.explode("hs").alias("h")))
    often = cut(flat.groupBy("h").agg(F.count("*").alias("often")))
    first = F.col("n") - F.ceil(F.col("n") * least - 1e-6) + 1
    place = F.row_number().over(Window.partitionBy("r").orderBy("often", "h"))
    keys = cut(flat.join(often, "h").withColumn("place", place).where(F.col("place") <= first).select("id", "c", "n", "h", "place"))
    mixed = cut(keys.groupBy("h").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("h"))
    odd = sets.select(F.col("id").alias("odd_id"), "odd")
    keys = cut(keys.join(mixed, "h", "left_semi").join(odd, F.col("id") == F.col("odd_id")))
    x, y = (keys.select(*[F.col(c).alias(n) for c, n in (("id", k), ("c", f"{k}_c"), ("n", f"{k}_n"), ("h", f"{k}_h"), ("place", f"{k}_at"), ("odd", f"{k}_odd"))]) for k in "ab")
    # the first shingle that two sets share leaves room for the overlap that they need; later ones needn't
    room = 1 + F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    fits = room >= (F.col("a_n") + F.col("b_n")) * (least / (1 + least)) - 1e-6
    apart = sum((F.bit_count(F.col("a_odd")[k].bitwiseXOR(F.col("b_odd")[k])) for k in range(PARITIES)), F.lit(0))
    fits = fits & (apart <= (F.col("a_n") + F.col("b_n")) * ((1 - least) / (1 + least)) + 1e-6)
    return x.hint("merge").join(y, (F.col("a_h") == F.col("b_h")) & (F.col("a") > F.col("b")) & (F.col("a_c") != F.col("b_c")) & fits).select("a", "b").distinct()


def _links(pairs: DataFrame, two: DataFrame, rows: DataFrame, kind: str, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are similar. Only those whose set sizes and sketches allow for it get their texts."""
    x, y = (rows.select(F.col("id").alias(f"{k}_id"), F.col("n").alias(f"{k}_n"), F.col("sketch").alias(f"{k}_sketch")) for k in "xy")
    fits = F.least("x_n", "y_n") >= F.greatest("x_n", "y_n") * least - 1e-6
    told = pairs.join(y, F.col("b") == F.col("y_id")).join(x, F.col("a") == F.col("x_id")).where(fits).select("a", "b", "x_sketch", "y_sketch")
    likely = cut(map_batches(told, partial(_likely_batches, least=least), f"a {kind}, b {kind}").distinct())
    x, y = (two.select(F.col("id").alias(f"{n}_id"), F.col("text").alias(f"{n}_text")) for n in "xy")
    texts = likely.join(y, F.col("b") == F.col("y_id")).select("a", "b", "y_text").join(x, F.col("a") == F.col("x_id")).select("a", "b", "x_text", "y_text")
    return map_batches(texts, partial(_verify_batches, shingle=shingle, least=least), f"a {kind}, b {kind}")


def _named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id and text of the rows with an id. Where ids repeat, id is a struct of it and the text's hash, so that each text counts."""
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    if two.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count():
        two = two.select(F.struct("id", F.xxhash64("text").alias("x")).alias("id"), "text").dropDuplicates(["id"])
    return two


def _close_fingerprints(two: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b), a > b, whose components are those of near_duplicates(): to the least id of an equal fingerprint, and between those of close ones."""
    own = cut(fingerprints(two, id_col="id"))
    nodes = _nodes(own)
    equal = own.join(nodes, "fp").where("doc_id <> least").select(F.col("doc_id").alias("a"), F.col("least").alias("b"))
    x, y = (nodes.select(F.col("fp").alias(k), F.col("least").alias(f"{k}_least")) for k in "ab")
    ends = F.col("a_least"), F.col("b_least")
    close = close_pairs(nodes, max_bits).join(x, "a").join(y, "b").select(F.greatest(*ends).alias("a"), F.least(*ends).alias("b"))
    return cut(equal.unionByName(close))


def _similar(two: DataFrame, shingle: int, least: float, tables: int, first: int, max_bits: int | None = None) -> DataFrame:
    """node and component of every id that links to another: by fingerprints of at most ``max_bits`` different bits, if given, or by similarity."""
    kind = two.schema["id"].dataType.simpleString()
    rows = cut(map_batches(two, partial(_table_batches, shingle=shingle, tables=tables, first=first), f"id {kind}, n long, fps array<long>, sketch binary"))
    keys = rows.select("id", F.posexplode("fps").alias("t", "fp"))
    picked = F.min_by("id", F.xxhash64("id", "t"))
    groups = cut(keys.groupBy("t", "fp").agg(F.min("id").alias("low"), picked.alias("pick"), F.count("*").alias("n")).where("n > 1").select(F.col("t").alias("t2"), F.col("fp").alias("fp2"), "low", "pick", "n"))
    grouped = cut(keys.join(groups, (F.col("t") == F.col("t2")) & (F.col("fp") == F.col("fp2"))).select("id", "t", "fp", "low", "pick", "n"))
    pair = [F.greatest("id", "other").alias("a"), F.least("id", "other").alias("b")]
    lows = cut(grouped.select("id", F.col("low").alias("other")).where("id <> other").select(*pair).distinct())
    links = cut(_links(lows, two, rows, kind, shingle, least))
    if max_bits is not None:
        links = links.unionByName(_close_fingerprints(two, max_bits))
    found = connected_components(links, "a", "b")

    # of the others that the hash picked, only those in other components
    of = cut(grouped.join(found, grouped["id"] == found["node"], "left").select("id", F.col("pick").alias("other"), F.coalesce("component", "id").alias("c")).distinct())
    apart = of.join(found, of["other"] == found["node"], "left").where(F.col("c") != F.coalesce("component", "other")).where("id <> other")
    more = cut(_links(cut(apart.select(*pair).distinct()), two, rows, kind, shingle, least))
    if more.limit(1).count():
        stars = found.select(F.col("node").alias("a"), F.col("component").alias("b"))
        found = connected_components(stars.unionByName(more), "a", "b")

    # what the stars leave (in groups of two they leave nothing), and the short texts
    of = cut(grouped.where("n > 2").join(found, grouped["id"] == found["node"], "left").select("id", "t", "fp", F.coalesce("component", "id").alias("c")))
    split = of.groupBy("t", "fp").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 <> c2").select("t", "fp")
    few = rows.where((F.col("n") > 0) & (F.col("n") <= FEW / least)).select("id").distinct()
    few = few.join(found, few["id"] == found["node"], "left").select("id", F.coalesce("component", "id").alias("c"))
    rest = cut(of.join(cut(split), ["t", "fp"], "left_semi").select("id", "c").unionByName(few).distinct())
    if n := rest.count():
        ids = small(rest, n, 2 * ID_BYTES)
        more = cut(_links(cut(_unlike_pairs(two.join(ids, "id").select("id", "c", "text"), kind, shingle, least)), two, rows, kind, shingle, least))
        found = _merged(found, more, rest)
    return found


def similar_documents(docs: DataFrame, shingle: int = 5, least: float = 0.8, tables: int = 20, first: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and component_id of every document that links to another: texts whose shingle sets have a Jaccard similarity of ``least``.

    Within a table's group of equal fingerprints each document is first compared with two others, the
    one of the smallest doc_id and one that a hash picks, unless they are in one component already. The documents of groups that this leaves in
    two components or more then go through an exact join of their shingle sets, so every link within
    a group is found, or its ends are in one component anyway. Texts of few shingles always go through
    it, whatever their groups. A null doc_id links to nothing; rows of the same doc_id with different
    texts are documents each, with a row each; rows that repeat in both count as one. An empty table
    gives an empty table; no other column is read.
    """
    two = _named(docs, id_col, text_col)
    found = _similar(two, shingle, least, tables, first)
    if two.schema["id"].dataType.typeName() == "struct" and docs.schema[id_col].dataType.typeName() != "struct":
        return found.select(F.col("node.id").alias("doc_id"), F.col("component.id").alias("component_id"))
    return found.select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))


def _merged(found: DataFrame, more: DataFrame, named: DataFrame) -> DataFrame:
    """node and component of ``found`` with the links (a, b) of ``more`` added; ``named`` has the component c of every id in it."""
    a, b = named.select(F.col("id").alias("a"), F.col("c").alias("a_c")), named.select(F.col("id").alias("b"), F.col("c").alias("b_c"))
    now = connected_components(more.join(a, "a").join(b, "b").select("a_c", "b_c"), "a_c", "b_c").select(F.col("node").alias("was"), F.col("component").alias("now"))
    alone = now.select(F.col("was").alias("node"), F.col("was").alias("component"))
    every = cut(found.unionByName(alone).distinct())  # a component of found is a node of it; new ones were alone
    return every.join(now, every["component"] == now["was"], "left").select("node", F.coalesce("now", "component").alias("component"))


def keep_one_of_each(docs: DataFrame, shingle: int = 5, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", max_bits: int | None = None) -> DataFrame:
    """The rows of ``docs`` but for those that are similar to others of a smaller doc_id, with all their columns.

    With ``max_bits``, texts whose fingerprints differ in so many bits at most, as near_duplicates() finds
    them, are linked too, and components are those of both kinds of links. Rows of one doc_id are told apart by their texts; rows that repeat in both stay or go together.
    """
    two = _named(docs, id_col, text_col)
    found = _similar(two, shingle, least, 20, 5, max_bits)
    gone = cut(found.where("node <> component").select("node").distinct())
    by_text = two.schema["id"].dataType.typeName() == "struct" and docs.schema[id_col].dataType.typeName() != "struct"
    keys = {"gone_id": "node.id", "gone_x": "node.x"} if by_text else {"gone_id": "node"}
    gone = small(gone.select(*[F.col(c).alias(n) for n, c in keys.items()]), gone.count(), ID_BYTES)
    match = docs[id_col] == gone["gone_id"]
    return docs.join(gone, match & (F.xxhash64(docs[text_col].cast("string")) == gone["gone_x"]) if by_text else match, "left_anti")
