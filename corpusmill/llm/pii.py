"""Personal data: exact patterns, and a linear-chain conditional random field that adds to them.

The patterns find e-mail addresses, IPv4 addresses, payment cards and phone numbers. The random
field labels words by their shapes, some cue words and those of their neighbours; it is trained from
the small labelled table below and finds names of persons, credentials and identity numbers. Its
spans are added unless they overlap one of the patterns'.

Decoding is Viterbi in numpy batches. A word whose best label leads by more than any change of its
two transitions could make up has that label on every best path; sequences are cut there, which
changes no result, and the short stretches in between are decoded together. Long texts are read in
blocks that end with a line or with such a word, so memory doesn't grow with a text.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from functools import partial
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import slices

KINDS = ("email", "ip", "card", "phone", "name", "secret", "id")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++")
_DIGITS = re.compile(r"[0-9]+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: The labelled table: a sentence a line, its personal data as [kind:words].
LABELLED = """
please ask [name:Maria Lopez] about the invoice .
Mr. [name:John Smith] will call you back tomorrow .
Mrs. [name:Anna Keller] signed the form last week .
Ms. [name:Priya Nair] was not in the office .
Dr. [name:Peter Brandt] sees patients on Monday .
my name is [name:Laura Garcia] and I live here .
his name is [name:Tom Becker] , he said .
her name is [name:Elena Petrova] .
Contact [name:Sara Jensen] for the details .
signed by [name:Henri Dubois] on behalf of the board .
Herr [name:Klaus Weber] wohnt in der Stadt .
Frau [name:Sabine Vogel] ist heute nicht da .
Mme [name:Claire Fontaine] est absente .
Monsieur [name:Luc Moreau] arrive demain .
Señora [name:Carmen Ruiz] vive en el centro .
Señor [name:Pablo Ortega] no vino .
mein Name ist [name:Jonas Wolf] und ich komme .
je m'appelle [name:Julie Marchand] et je viens .
me llamo [name:Diego Torres] y vengo .
Dear Mr. [name:Clark] , thank you .
Mr. [name:Walter Gruber], please come in .
Dr. [name:Nina Rossi], too, was there .
Contact [name:Omar Haddad], the clerk .
my name is [name:Rosa Klein].
Herr [name:Otto Braun], bitte warten .
the login is password=[secret:hunter2x99] for now .
and password=[secret:7602ad27cf5550de1c] was found there
set password=[secret:b7db7aa4a5fcc78305] in the file
password: [secret:Tr0ub4dor3] please
your token = [secret:9ac2f81d0be14c5a77] in the log
token = [secret:"51aa0c9e7b3d2288f0"] and then
token: [secret:eyJhbGciOiJIUzI1NiJ9] is sent along
the api_key = [secret:"f00dbabe1234567890ab"] leaked
api_key=[secret:live51Hq2aB9cD0e] is in use
the key [secret:Q7XK2M9PLT4ZR8WA] was used by them
with [secret:K3B8Z0V5N1C6M2X7] in it .
secret: [secret:s3cr3tPassw0rd] do not share
her SSN is [id:123-45-6789] on the form
SSN [id:987-65-4321] was entered .
social security number [id:321-54-9876] .
passport number [id:X1234567] expires soon .
passport no. [id:C01X00T47] was lost .
IBAN [id:DE89370400440532013000] is theirs
the IBAN is [id:FR1420041010050500013M02606] .
the meeting is at the office in the morning .
The house is of red stone and has a garden .
And then the river was low . The banks were dry .
In London the rain fell for three days .
Paris and Berlin are far from here .
He said that the Monday train was late .
Order 4711 was shipped on 12.05.2024 with 3 items .
It cost 1999 and weighs 12.5 kg in 2023 .
The password was never told to anyone .
a token of thanks was given to them .
the key is under the mat , the door is open .
my name is not important here .
The name of the street is Long Lane .
HURRY!!! Sale ends SOON! Don't miss it!!
Wow*** so### many&&& marks%%% here$$$
Und die Kinder spielen im Garten mit dem Ball .
Der Weg ist weit und das Wetter ist gut .
La maison est grande et le jardin aussi .
El perro y la casa de la montaña .
Que la mer est belle . Les bateaux sont partis .
see https://example.org/a/b?c=1 for more .
version 1.2.3 of build 20240101 is out .
Chapter 7 begins with the storm .
Published under the Terms of Use, Edition 4.
All Rights Reserved. Copyright Example Corporation 2020.
It ended. The Rest is known. And So on.
He is by. They Were gone.
Here is. That Was all.
The way is. And Then they left by. The End.
Von der. Die Stadt ist. Das Haus.
Le jour est. La Nuit est noire.
Es la. El Dia es. Los Otros.
New York and South Africa are far.
The Society of Friends of Music of America.
Title Case Words Stand Here Alone.
"""

LABELS = ("O", *(f"{p}-{k}" for k in ("name", "secret", "id") for p in "BI"))
_CUES = frozenset(
    "Mr. Mrs. Ms. Dr. Herr Frau Mme Monsieur Señora Señor name Name is Contact contact signed by ask Dear ist m'appelle llamo "
    "password password: token token: api_key secret secret: = key ssn SSN iban IBAN passport number no. social security mein je me".split()
)
_HAS = (("x", re.compile(r"[a-z]")), ("X", re.compile(r"[A-Z]")), ("d", re.compile(r"[0-9]")), ("-", re.compile(r"[^A-Za-z0-9]")))
#: A shape of more marks than this is told by the kinds of marks in the whole word instead.
SHAPE = 12


def shape(word: str) -> str:
    """Letters as X or x, digits as d, repeats of more than two cut, other marks as they are; ~ and the kinds of marks for long shapes."""
    out: list[str] = []
    for c in word:
        k = "x" if c.islower() else "X" if c.isupper() else "d" if c.isdigit() else "x" if c.isalpha() else c
        if len(out) < 2 or out[-1] != k or out[-2] != k:
            if len(out) == SHAPE:
                return "~" + "".join(mark for mark, kind in _HAS if kind.search(word))
            out.append(k)
    return "".join(out)


def features(word: str) -> list[str]:
    """What is known of a word: its coarse shape, cues it is or starts with, and a length class."""
    core = word.strip("\"'.,;:!?()")
    plain = core.isalpha()
    kind = ("title" if core[:1].isupper() and core[1:].islower() and len(core) > 1 else "lower" if core.islower() else "upper" if core.isupper() else "mixed") if plain else "none" if not core else "num" if core.isdigit() else "mark"
    out = [f"kind={kind}"]
    if word[-1:] in ".,;:!?" and word[-1:] != word:
        out.append("ends" if word[-1] in ".!?" else "pauses")
    if word in _CUES:
        out.append(f"cue={word}")
    if plain:
        return out
    out.append(f"shape={shape(core)}")
    if len(core) >= 7 and core.isalnum() and _HAS[2][1].search(core) and not core.isdigit():
        case = "upper" if core.isupper() else "lower" if core.islower() else "mixed"
        out.append(f"code={case}{'-long' if len(core) >= 16 else ''}")
    if "=" in core:
        head = core.partition("=")[0].lower()
        out.append("assign=" + (head if head in ("password", "token", "api_key", "secret") else "other"))
    return out


class ChainField:
    """A linear-chain conditional random field with features of a word and of its two neighbours."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, step: np.ndarray, first: np.ndarray, last: np.ndarray):
        self.names, self.emit, self.step, self.first, self.last = names, emit, step, first, last

    @staticmethod
    def sequence(line: str) -> tuple[list[str], list[int]]:
        words, labels = [], []
        for m in re.finditer(r"(\S*?)\[(\w+):([^\]]+)\](\S*)|(\S+)", line):
            if m[5]:
                words.append(m[5])
                labels.append(0)
            else:
                own = m[3].split()
                for k, w in enumerate(own):
                    words.append(m[1] * (k == 0) + w + m[4] * (k + 1 == len(own)))
                    labels.append(LABELS.index(("B-" if k == 0 else "I-") + m[2]))
        return words, labels

    @classmethod
    def train(cls, table: str = LABELLED, steps: int = 200, ridge: float = 0.02) -> ChainField:
        data = [cls.sequence(x) for x in table.strip().split("\n")]
        names: dict[str, int] = {}
        for words, _ in data:
            for w in words:
                for f in features(w):
                    for at in "-0+":
                        names.setdefault(at + f, len(names))
        n, k = len(names), len(LABELS)
        theta = np.zeros(n * k + k * k + 2 * k)
        facts = [cls._facts(words, names) for words, _ in data]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for it in range(1, steps + 1):
            grad = np.zeros_like(theta)
            emit, step, first, last = cls._part(theta, n, k)
            g_emit, g_step, g_first, g_last = cls._part(grad, n, k)
            for (words, labels), rows in zip(data, facts):
                e = np.stack([emit[r].sum(axis=0) for r in rows])
                t = len(words)
                a, b = np.zeros((t, k)), np.zeros((t, k))
                a[0] = first + e[0]
                for i in range(1, t):
                    a[i] = np.logaddexp.reduce(a[i - 1][:, None] + step, axis=0) + e[i]
                b[-1] = last
                for i in range(t - 2, -1, -1):
                    b[i] = np.logaddexp.reduce(step + (e[i + 1] + b[i + 1])[None], axis=1)
                z = np.logaddexp.reduce(a[-1] + last)
                p = np.exp(a + b - z)
                for i, r in enumerate(rows):
                    d = -p[i]
                    d[labels[i]] += 1
                    g_emit[r] += d
                for i in range(1, t):
                    g_step -= np.exp(a[i - 1][:, None] + step + (e[i] + b[i])[None] - z)
                    g_step[labels[i - 1], labels[i]] += 1
                g_first -= p[0]
                g_first[labels[0]] += 1
                g_last -= p[-1]
                g_last[labels[-1]] += 1
            grad -= ridge * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
            theta += 0.1 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-6)
        emit, step, first, last = cls._part(theta, n, k)
        return cls(names, emit.copy(), step.copy(), first.copy(), last.copy())

    @staticmethod
    def _part(theta: np.ndarray, n: int, k: int):
        a, b = n * k, n * k + k * k
        return theta[:a].reshape(n, k), theta[a:b].reshape(k, k), theta[b : b + k], theta[b + k :]

    @staticmethod
    def _facts(words: list[str], names: dict[str, int]) -> list[list[int]]:
        own = [features(w) for w in words]
        out = []
        for i in range(len(words)):
            around = [("0", own[i])]
            if i:
                around.append(("-", own[i - 1]))
            if i + 1 < len(words):
                around.append(("+", own[i + 1]))
            out.append([names[at + f] for at, fs in around for f in fs if at + f in names])
        return out

    def word_scores(self, known: tuple[str, ...]) -> np.ndarray:
        """Three rows: what a word with these features adds to the labels of the word before it, of itself and of the word after it."""
        out = np.zeros((3, len(LABELS)))
        for row, at in ((0, "+"), (1, "0"), (2, "-")):
            for f in known:
                if at + f in self.names:
                    out[row] += self.emit[self.names[at + f]]
        return out

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best labels of one sequence of emissions, by plain dynamic programming."""
        score, back = self.first + e[0], []
        for row in e[1:]:
            at = score[:, None] + self.step
            back.append(at.argmax(axis=0))
            score = at.max(axis=0) + row
        label = int((score + self.last).argmax())
        out = [label]
        for b in reversed(back):
            label = int(b[label])
            out.append(label)
        return np.array(out[::-1])

    @staticmethod
    def _reach(step: np.ndarray, ahead: np.ndarray) -> np.ndarray:
        """By how much each label but 0 can gain on label 0 through the word before, where ahead bounds that word's own gains.

        A path through label i is compared with the one that stays in i and the one that stays in 0.
        """
        stay = np.maximum(step[1:, 0], step[0, 0] - ahead)  # of label 0, over the path that came by i
        return np.maximum((step[None, 1:, 1:] - stay[:, :, None]).max(axis=1), step[0, 1:] - step[0, 0])

    def sure(self, e: np.ndarray, inner: np.ndarray) -> np.ndarray:
        """Which words have label 0 on every best path: no other label's emission and transitions can make up for its own.

        inner tells where a word has one before it in its sequence. First any neighbours are allowed
        for; the words that leaves open are looked at again with bounds of what their neighbours can be.
        """
        into, out = np.vstack([self.step, self.first]), np.vstack([self.step.T, self.last])  # rows: the label before or after
        left, right = ((x - x[:, :1]).max(axis=0)[1:] for x in (into, out))
        own = e[:, 1:] - e[:, :1]
        found = (own + left + right + 1e-6 < 0).all(axis=1)
        at = np.flatnonzero(~found)
        if len(at):
            before, after = inner[at], np.append(inner, False)[at + 1]
            a, b = np.tile(left, (len(at), 1)), np.tile(right, (len(at), 1))
            a[before] = np.minimum(left, self._reach(self.step, own[at[before] - 1] + left))
            b[after] = np.minimum(right, self._reach(self.step.T, own[at[after] + 1] + right))
            found[at] = (own[at] + a + b + 1e-6 < 0).all(axis=1)
        return found

    def decode(self, e: np.ndarray, ends: np.ndarray, goes_on: bool = False, unfinished: bool = False) -> np.ndarray:
        """The best labels of many sequences, one after another in ``e``; ends: where each one ends.

        goes_on: the first sequence follows a word of label 0. unfinished: the last one ends with a sure word, not with its line.
        """
        n = len(e)
        out = np.zeros(n, np.int8)
        if not n:
            return out
        starts = np.concatenate([[0], ends[:-1]])
        full = e.copy()
        full[starts[goes_on:]] += self.first
        if goes_on:
            full[0] += self.step[0]
        full[ends[: len(ends) - unfinished] - 1] += self.last
        inner = np.ones(n, bool)
        inner[starts] = False
        sure = self.sure(e, inner)
        sure[n - 1] |= unfinished
        open_ = np.flatnonzero(~sure)
        if not len(open_):
            return out
        cuts = np.flatnonzero((np.diff(open_) > 1) | ~inner[open_[1:]])
        lo = open_[np.concatenate([[0], cuts + 1])]
        hi = open_[np.concatenate([cuts, [len(open_) - 1]])] + 1
        # a stretch next to a sure word takes the transition from or to label 0
        full[lo] += np.where(inner[lo][:, None], self.step[0], 0)
        after = np.append(inner, False)[hi]
        full[hi - 1] += np.where(after[:, None], self.step[:, 0], 0)
        size = hi - lo
        order = np.argsort(-size, kind="stable")
        for at in range(0, len(order), 4096):
            own = order[at : at + 4096]
            lengths = size[own]
            score = full[lo[own]].copy()
            back = []
            for t in range(1, int(lengths[0])):
                m = int(np.searchsorted(-lengths, -t, side="left"))  # those longer than t
                step = score[:m, :, None] + self.step
                back.append(step.argmax(axis=1).astype(np.int8))
                score[:m] = step.max(axis=1) + full[lo[own[:m]] + t]
            label = score.argmax(axis=1)
            for t in range(int(lengths[0]) - 1, -1, -1):
                m = int(np.searchsorted(-lengths, -t, side="left"))
                out[lo[own[:m]] + t] = label[:m]
                if t:
                    label[:m] = back[t - 1][np.arange(m), label[:m]]
        return out


def _luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, int]]:
    r"""Matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+, in time that grows with the text: from each @ to both sides."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            done = m.end()
            out.append((start, done, 0))
        at = text.find("@", max(at + 1, done))
    return out


def _numbers(text: str) -> list[tuple[int, int, int]]:
    """Addresses and cards that hold, from the runs of digits and what stands between them.

    An address is four runs with points between, each at most 255; a card is all runs that single
    blanks or hyphens join, 14 to 19 digits that pass Luhn's check. Both go over the runs once.
    """
    out, runs, last = [], [], -2  # the runs so far that points join
    card: list[tuple[int, int]] = []

    def judged() -> None:
        n = sum(e - s for s, e in card)
        if 14 <= n <= 19 and _luhn("".join(text[s:e] for s, e in card)):
            out.append((card[0][0], card[-1][1], 2))

    for m in _DIGITS.finditer(text):
        s, e = m.span()
        runs = [*runs, (s, e)] if runs and s == last + 1 and text[last] == "." else [(s, e)]
        if len(runs) == 4:
            if all(len(p) <= 3 and int(p) <= 255 for p in (text[a:b].lstrip("0") or "0" for a, b in runs)):
                out.append((runs[0][0], e, 1))
            runs = []
        if card and s == last + 1 and text[last] in " -":
            if len(card) < 20:  # longer ones fail anyway
                card.append((s, e))
        else:
            judged()
            card = [(s, e)]
        last = e
    judged()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the patterns' matches that hold: leftmost, not overlapping within a kind, no retries."""
    out = _emails(text) + _numbers(text)
    if "+" in text:
        out += [(m.start(), m.end(), 3) for m in PHONE.finditer(text) if 10 <= sum(map(m[0].count, "0123456789")) <= 15]
    return sorted(out)


_WORD, _BLANK = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[\x20\x09-\x0D]")
_EDGE = "\"'.,;:!?()[]{}<>"


class Finder:
    """A trained field with a bounded memory of the scores of words."""

    CACHE, LONGEST = 200_000, 200
    BLOCK = 400_000

    def __init__(self, field: ChainField):
        self.field = field
        self.forget()

    def forget(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.kinds: dict[tuple, int] = {}  # words with the same features share a row
        self.rows: list[np.ndarray] = []
        self.table = None

    def _id(self, raw: bytes) -> int:
        if (k := self.ids.get(raw)) is None:
            known = tuple(features(raw.decode("utf-8", "surrogatepass")))
            if (k := self.kinds.get(known)) is None:
                k = self.kinds[known] = len(self.rows)
                self.rows.append(self.field.word_scores(known))
            if len(raw) <= self.LONGEST:
                self.ids[raw] = k
        return k

    def _emissions(self, at: np.ndarray, end: np.ndarray, before: int | None = None, after: int | None = None) -> np.ndarray:
        """The scores of words by their rows; end: where lines end; before, after: the rows of the words around, in the same lines."""
        if self.table is None or len(self.table) < len(self.rows):
            fresh = np.stack(self.rows[0 if self.table is None else len(self.table) :])
            self.table = fresh if self.table is None else np.concatenate([self.table, fresh])
        e = self.table[at, 1]
        inner = np.ones(len(at), bool)
        inner[end[:-1]] = inner[0] = False  # where a word is before it in its line
        later = np.flatnonzero(inner)
        e[later - 1] += self.table[at[later], 0]
        e[later] += self.table[at[later - 1], 2]
        if before is not None:
            e[0] += self.table[before, 2]
        if after is not None:
            e[-1] += self.table[after, 0]
        return e

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """The rows of the texts' words, where their lines end, and each text's number of words."""
        words, ends, counts = [], [], []
        for text in texts:
            n = len(words)
            for line in text.encode("utf-8", "surrogatepass").split(b"\n"):
                if own := line.split():  # bytes: at ASCII white space
                    words += own
                    ends.append(len(words))
            counts.append(len(words) - n)
        near = {w: self._id(w) for w in set(words)}
        return np.array(list(map(near.__getitem__, words)), np.int64), np.array(ends, np.int64), counts

    def labels(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text's words, in order. A sequence is a line."""
        if len(self.ids) > self.CACHE:
            self.forget()
        at, end, counts = self._words(texts)
        if not len(at):
            return [np.zeros(0, np.int8)] * len(texts)
        found = self.field.decode(self._emissions(at, end), end)
        return np.split(found, np.cumsum(counts)[:-1])

    def _long(self, text: str) -> list[tuple[int, int, int]]:
        """As labelled() for one text of any length, in blocks."""
        out, at, before = [], 0, None  # before: the last word, if it is in the same line
        while at < len(text):
            if len(self.ids) > self.CACHE and before is None:
                self.forget()
            size = self.BLOCK
            while True:
                blank = _BLANK.search(text, min(len(text), at + size))
                to = blank.start() if blank else len(text)
                line, following = text.rfind("\n", at, to), _WORD.search(text, to)
                if to < len(text) and line >= 0:
                    to, after, following = line + 1, None, _WORD.search(text, line + 1)
                else:
                    after = following if following and "\n" not in text[to : following.start()] else None
                piece = text[at:to]
                rows, ends, _ = self._words([piece])
                if after is None or not len(rows):
                    stop = len(rows)
                    break
                e = self._emissions(rows, ends, before, self._id(after[0].encode("utf-8", "surrogatepass")))
                inner = np.ones(len(rows), bool)
                inner[ends[:-1]] = inner[0] = False
                sure = np.flatnonzero(self.field.sure(e, inner)[1:])
                if len(sure):
                    stop = int(sure[-1]) + 2  # up to and with the last sure word
                    break
                size *= 2
            if not len(rows):  # nothing but white space up to the next word
                line = "\n" in text[at : following.start()] if following else True
                at, before = following.start() if following else len(text), None if line else before
                continue
            unfinished = after is not None
            e = self._emissions(rows, ends, before) if not unfinished else e
            ends = ends if not unfinished else np.array([stop])
            found = self.field.decode(e[:stop], ends, before is not None, unfinished)
            out += self._spans(piece, found, at)
            if unfinished:
                before = int(rows[stop - 1])
                *_, last = islice(_WORD.finditer(piece), stop)
                at += last.end()
            else:
                at, before = to, None
        return out

    @staticmethod
    def _spans(text: str, labels: np.ndarray, offset: int = 0) -> list[tuple[int, int, int]]:
        """The spans of labelled words, without marks at their edges."""
        if not labels.any():
            return []
        out, open_kind, words = [], None, list(_WORD.finditer(text))
        for k in np.flatnonzero(labels).tolist():
            m, kind = words[k], (int(labels[k]) - 1) // 2
            w = m[0]
            lead = w.find("=") + 1 if KINDS[4 + kind] == "secret" else 0
            lead += len(w[lead:]) - len(w[lead:].lstrip(_EDGE))
            start, end = offset + m.start() + lead, offset + m.start() + len(w.rstrip(_EDGE))
            if start >= end:
                continue
            if labels[k] % 2 == 0 and out and open_kind == (kind, k - 1):
                out[-1] = (out[-1][0], end, 4 + kind)
            else:
                out.append((start, end, 4 + kind))
            open_kind = (kind, k)
        return out

    def labelled(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """The spans that the field finds in each text."""
        short = [x if len(x) <= self.BLOCK else "" for x in texts]
        found = [self._spans(x, own) for x, own in zip(short, self.labels(short))]
        return [own if len(x) <= self.BLOCK else self._long(x) for x, own in zip(texts, found)]


def without_overlaps(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap no base span; base is sorted."""
    starts, reach, far = [], [], 0
    for a, b, _ in base:
        far = max(far, b)
        starts.append(a)
        reach.append(far)  # the end of all that start up to here
    return [s for s in spans if not (k := bisect_right(starts, s[1] - 1)) or reach[k - 1] <= s[0]]


def spans_text(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def _find_batches(batches, shared):
    finder = Finder(shared.value)
    for batch in batches:
        texts = [x or "" for x in batch.column(1).to_pylist()]
        rows = []
        for lo, hi in slices(texts, 400_000):
            for text, added in zip(texts[lo:hi], finder.labelled(texts[lo:hi])):
                base = base_spans(text)
                counts = [sum(k == n for _, _, k in base) for n in range(4)]
                rows.append((*counts, hashlib.sha256(spans_text(base).encode()).hexdigest(), spans_text(base + without_overlaps(added, base))))
        columns = list(zip(*rows)) if rows else [()] * 6
        kinds = [pa.int64()] * 4 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])


def find_personal_data(docs: DataFrame, field: ChainField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base matches), base_sha256, spans of every document.

    Spans are kind:start:end in code points, end exclusive, by start, then kind. Null counts as empty;
    a text without personal data has an empty list. Repeated rows stay; an empty table gives an empty
    table; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field or ChainField.train())  # as large as the labelled table makes it
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(partial(_find_batches, shared=shared), f"doc_id {two.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str, spans: str) -> str:
    """The text with each span replaced by its kind in angle brackets."""
    out, at = [], 0
    for kind, a, b in (x.split(":") for x in spans.split(",") if x):
        if int(a) >= at:
            out += [text[at : int(a)], f"<{kind}>"]
            at = int(b)
    return "".join([*out, text[at:]])
