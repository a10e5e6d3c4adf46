"""Best-fit packing with certified bin counts.

Texts are tokenised, long ones cut into full pieces, and the pieces dealt into groups of a bounded
size. Each group is packed by best-fit decreasing. Dual-feasible functions give a lower bound of the
group's bins; a group whose count meets it is certified and done, except for its emptiest bin.
Groups with a gap, and the emptiest bin of each group, give up their loosest bins; those pieces are
exchanged (dealt into fewer, new groups) and packed again. A repacking counts only if it needs fewer
bins than before.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import cut, map_batches, portions

CAPACITY = 4096
END = 1
#: Pieces of a group, and the sequences' worth of tokens that a group has at least, so that groups of tiny pieces are larger.
GROUP, LEAST_BINS = 4096, 16
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that a task tokenises at once, and words that it remembers: more is faster and takes more memory.
CHUNK, WORDS = 600_000, 200_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordTokens:
    """Token ids of whole texts for a tokenizer that never joins pieces over white space.

    A text's ids are its blank-separated words' ids one after another, so words are looked up in a
    bounded cache. New words of plain Latin letters, digits and ASCII marks are merged here, many at
    a time; any other word goes through the tokenizer itself.
    """

    LONGEST = 48
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+|\n")

    def __init__(self, path: str, cache: int = WORDS):
        import json

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:  # a file of an installed package, on every machine
            model = json.load(f)["model"]
        self.whole, self.cache = Tokenizer.from_file(path), cache
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        shown = _byte_characters()
        self.inner = np.array([vocab[c] for c in shown], np.int32)
        self.last = np.array([vocab[c + end] for c in shown], np.int32)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs] + [0], np.int32)
        bits = 20  # open addressing, at most one slot in twenty used
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, len(pairs), np.int32)
        for key, rank, at in zip(keys.tolist(), range(len(pairs)), self._slot(keys).tolist()):
            while self.keys[at] != -1:
                at = at + 1 & self.mask
            self.keys[at], self.ranks[at] = key, rank
        self.none = len(pairs)
        self.marks = {ord(c): int(vocab[c + end]).to_bytes(4, "little") for c in ".,"}
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; ``none`` where there is no such merge."""
        keys = a.astype(np.int64) << 16 | b
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.ranks[at], np.int32(self.none))
        todo = np.flatnonzero((held != keys) & (held != -1))
        at = at[todo]
        while len(todo):
            at = at + 1 & self.mask
            held, own = self.keys[at], keys[todo]
            hit = held == own
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (held != -1)
            todo, at = todo[on], at[on]
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece: its lowest-ranked pair is merged, the leftmost first, until none is left.

        Pieces of one length go together: all rows lose one place a step.
        """
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        out: list[bytes] = [b""] * len(pieces)

        def put(rows: np.ndarray, ids: np.ndarray) -> None:
            raw, size = ids.astype("<u4").tobytes(), 4 * ids.shape[1]
            for at, k in enumerate(rows.tolist()):
                out[k] = raw[at * size : at * size + size]

        order = np.argsort(lengths, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
            w = int(lengths[rows[0]])
            raw = np.frombuffer(b"".join(map(pieces.__getitem__, rows.tolist())), np.uint8).reshape(-1, w)
            ids = self.inner[raw]
            ids[:, -1] = self.last[raw[:, -1]]
            ranks = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(rows), w - 1)
            while w > 1:
                best = ranks.argmin(axis=1)
                rank = ranks[np.arange(len(rows)), best]
                on = rank < self.none
                if not on.all():
                    put(rows[~on], ids[~on])
                    rows, ids, ranks, best, rank = rows[on], ids[on], ranks[on], best[on], rank[on]
                if not len(rows):
                    break
                k = np.arange(len(rows))
                ids[k, best] = self.made[rank]
                stay = np.ones(ids.shape, bool)
                stay[k, best + 1] = False
                ids, w = ids[stay].reshape(len(k), w - 1), w - 1
                stay = np.ones(ranks.shape, bool)
                stay[k, np.minimum(best + 1, w - 1)] = False
                ranks = ranks[stay].reshape(len(k), w - 1)
                left = np.flatnonzero(best > 0)
                at = best[left]
                ranks[left, at - 1] = self._rank(ids[left, at - 1], ids[left, at])
                right = np.flatnonzero(best < w - 1)
                at = best[right]
                ranks[right, at] = self._rank(ids[right, at], ids[right, at + 1])
            if len(rows):
                put(rows, ids)
        return out

    def _learn(self, words: list[bytes]) -> None:
        """Adds the ids of words to the cache."""
        if not words:
            return
        line = b"\n".join(words).decode("utf-8", "surrogatepass")
        texts = line.split("\n")
        fits = [len(x) <= self.LONGEST and self.PLAIN.fullmatch(x) is not None and "<|" not in x for x in texts]
        if not all(fits):
            for word, text, ok in zip(words, texts, fits):
                if not ok:
                    ids = self.whole.encode(text.encode("utf-8", "replace").decode(), add_special_tokens=False).ids
                    self.young[word] = np.array(ids, "<u4").tobytes()
            words = [w for w, ok in zip(words, fits) if ok]
            line = "\n".join(x for x, ok in zip(texts, fits) if ok)
        if not words:
            return
        found = self.PIECES.findall(line.lower())
        unique = list(set(found) - {"\n"})
        merged = dict(zip(unique, self._merge([x.encode() for x in unique])))
        merged["\n"] = b"\xff\xff\xff\xff"  # no id is so large
        flat = np.frombuffer(b"".join(map(merged.__getitem__, found)), "<u4")
        raw, ends = flat.tobytes(), (4 * np.flatnonzero(flat == 0xFFFFFFFF)).tolist()
        starts = [0, *(x + 4 for x in ends)]
        self.young.update(zip(words, map(raw.__getitem__, map(slice, starts, [*ends, len(raw)]))))

    def _words(self, raw: bytes) -> list[bytes]:
        """Blank-separated words; the model lower-cases, so A-Z can go first, unless a special token may be named."""
        return raw.split() if b"<|" in raw else raw.lower().split()

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit numbers."""
        split = [self._words((x or "").encode("utf-8", "surrogatepass")) for x in texts]
        if len(self.young) > self.cache:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        words = set().union(*split)
        new, marked = set(), []
        for w in words.difference(young):
            if (held := old.get(w)) is not None:
                young[w] = held
            elif len(w) > 1 and w[-1] in self.marks and 97 <= w[-2] <= 122:
                marked.append(w)  # the mark is a piece of its own after a letter
                new.add(w[:-1])
            else:
                new.add(w)
        self._learn([w for w in new if w not in young])
        young.update((w, young[w[:-1]] + self.marks[w[-1]]) for w in marked)
        near = dict(zip(words, map(young.__getitem__, words)))  # small enough to stay in the processor's cache
        return [b"".join(map(near.__getitem__, words)) for words in split]


def _byte_characters() -> list[str]:
    """The printable character that byte-level vocabularies show each byte as."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(shown) else chr(next(rest)) for b in range(256)]


_TOKENS: dict[tuple[str, int], WordTokens] = {}


def word_tokens(path: str, cache: int = WORDS) -> WordTokens:
    if (path, cache) not in _TOKENS:
        _TOKENS[path, cache] = WordTokens(path, cache)
    return _TOKENS[path, cache]


def _piece_batches(batches, tokenizer, capacity, chunk, cache):
    model = word_tokens(tokenizer_path(tokenizer), cache)
    end = END.to_bytes(4, "little")
    for batch in portions(batches, 1, chunk):
        rows = []
        for k, ids in enumerate(model.ids(batch.column(1).to_pylist())):
            ids += end
            rows += [(k, p, at // 4, min(4 * capacity, len(ids) - at) // 4, zlib.crc32(ids[at : at + 4 * capacity])) for p, at in enumerate(range(0, len(ids), 4 * capacity))]
        k, piece, start, length, crc = zip(*rows) if rows else ((), (), (), (), ())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(k, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])


def token_pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, cache: int = WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut only if longer than a sequence."""
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = two.schema["doc_id"].dataType.simpleString()
    return map_batches(two, partial(_piece_batches, tokenizer=tokenizer, capacity=capacity, chunk=chunk, cache=cache), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def lower_bound(sizes: np.ndarray, capacity: int = CAPACITY) -> int:
    """The least number of bins that dual-feasible functions prove, for sizes from 1 to capacity.

    Two families: x -> C, x or 0 for x above C - k, from k to C - k, below k (all k up to C / 2); and
    the rounding x -> (x if (j + 1) x is a multiple of C, else C floor((j + 1) x / C) / j), for small j.
    """
    if not len(sizes):
        return 0
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1)
    upto, words = np.cumsum(count), np.cumsum(count * x)
    best = -(-int(words[-1]) // capacity)
    k = np.arange(1, capacity // 2 + 1)
    big, mid = upto[-1] - upto[capacity - k], words[capacity - k] - words[k - 1]
    best = max(best, int((big + -(-mid // capacity)).max()))
    for j in range(1, 12):
        up = (j + 1) * x
        value = np.where(up % capacity == 0, x * j, capacity * (up // capacity))  # times j
        best = max(best, -(-int((count * value).sum()) // (capacity * j)))
    return best


def best_fit_decreasing(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """The bin and the offset of each item, and each bin's free room. Large items first, each into the fullest bin that takes it."""
    order = np.argsort(-sizes, kind="stable")
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room: list[int] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # those of which there is a bin, in order
    for i, size in zip(order.tolist(), sizes[order].tolist()):
        at = bisect_left(rooms, size)
        if at == len(rooms):
            held, b = capacity, len(room)
            room.append(capacity)
        else:
            held = rooms[at]
            b = by_room[held].pop()
            if not by_room[held]:
                rooms.pop(at)
        bins[i], offsets[i] = b, capacity - held
        room[b] = left = held - size
        if not by_room[left]:
            rooms.insert(bisect_left(rooms, left), left)
        by_room[left].append(b)
    return bins, offsets, room


def _pack_group(key, pdf: pd.DataFrame, capacity: int, slack: float, last: bool, base: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "row"], ascending=[False, True], kind="stable")
    sizes = pdf["length"].to_numpy(np.int64)
    bins, offsets, room = best_fit_decreasing(sizes, capacity)
    free = np.array(room)
    gap = len(room) - lower_bound(sizes, capacity)
    given = np.zeros(len(room), bool)
    if not last:
        given[int(free.argmax())] = True
        if gap:
            given |= free > slack * capacity
    pdf["sequence_id"] = (np.int64(base + int(key[0])) << 32) + bins
    pdf["offset"] = offsets
    pdf["gap"] = np.int64(gap)
    pdf["given"] = given[bins]
    return pdf


def _by_group(run):
    def packed(key, pdf):
        return run(key, pdf)

    return packed


def pack(pieces: DataFrame, capacity: int = CAPACITY, group: int = GROUP, rounds: int = 3, slack: float = 0.02) -> DataFrame:
    """Adds sequence_id, offset and gap to a table of pieces (doc_id, piece, start, length, ids_crc32).

    ``group`` pieces, about, are packed in one task, or more of them if they are so small that they fill
    less than LEAST_BINS sequences; pieces are dealt by a hash of their row numbers, so
    equal ones spread as others do. Each round packs what the groups of the round before gave up; a
    round that saves no bin is undone and ends the exchange. gap is how many bins the packing of the
    piece's group needed beyond its lower bound: 0 certifies that no packing of the group needs fewer.
    """
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in pieces.select(*names).schema]
    schema = ", ".join([*kinds, "row long", "grp long", "sequence_id long", "offset long", "gap long", "given boolean"])
    left, base, done = cut(pieces.select(*names, F.monotonically_increasing_id().alias("row"))), 0, None
    was, were = None, None
    for k in range(rounds + 1):
        n, tokens = left.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        groups = max(1, min(-(-n // group), tokens // (capacity * LEAST_BINS)))
        # a hash that shares nothing with the one that deals rows to tasks, so that groups spread
        deal = F.pmod(F.xxhash64(F.lit(f"round {k}"), "row", "ids_crc32"), F.lit(groups))
        run = partial(_pack_group, capacity=capacity, slack=slack, last=k == rounds or (groups == 1 and k > 0), base=base)
        packed = left.withColumn("grp", deal).groupBy("grp").applyInPandas(_by_group(run), schema)
        packed = cut(packed)
        base += groups
        bins = packed.select("sequence_id").distinct().count()
        if were is not None and bins >= were:  # no bin saved: the exchanged pieces stay where they were
            done = done.unionByName(was)
            break
        kept = packed.where("not given")
        done = kept if done is None else done.unionByName(kept)
        was = packed.where("given")
        were = was.select("sequence_id").distinct().count()
        if were < 2:
            done = done.unionByName(was)
            break
        left = was.select(*names, "row")
    return done.select(*names, "sequence_id", "offset", "gap")


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", certified: bool = False, chunk: int = CHUNK, cache: int = WORDS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document; gap too, if ``certified``.

    Null and empty texts are one piece with the end id. Repeated rows are packed each for itself. An
    empty table gives an empty table; no other column is read.
    """
    packed = pack(token_pieces(docs, tokenizer, capacity, id_col, text_col, chunk, cache), capacity)
    return packed if certified else packed.drop("gap")
