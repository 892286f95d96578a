"""Secret scans: patterns, and a linear-chain conditional random field over words, decoded by Viterbi."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.hashing import split_words
from tidewire.llm.shared import tidy
from tidewire.llm.token_files import slices

#: Base patterns by kind, and the least length of group `part` of a match.
BASE = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)
#: A text without any of these has no base match.
HINTS = (r"""(?i)(password|passwd|secret|token|api_?key)["']? *[:=]""", "AKIA[A-Z0-9]{16}", "[0-9a-f]{24}")
KINDS = ("assign", "access", "hex", "crf")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Documents of the training sample, at most: those of least hash.
SAMPLE = 2000
SIZE = 1 << 14
OUT, BEGIN, INSIDE = range(3)
#: Words that make a secret likely nearby.
CUES = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "key", "bearer", "credential", "credentials", "auth", "authorization", "private", "access")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end (code points) of the base matches, by start, then kind as listed."""
    found = [(kind, m.start(), m.end()) for kind, p, part, least in BASE for m in p.finditer(text) if len(m[part]) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


@cache
def _slot(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % SIZE


def word_features(word: str) -> list[str]:
    """Shape, length, mixture and cue features of a word, whatever stands around it."""
    core = word.strip("\"'`.,;:!?()[]{}<>*#$%&|")
    n = len(core)
    kinds = (any(c.isdigit() for c in core), any(c.islower() for c in core), any(c.isupper() for c in core), any(c in "+/_=-" for c in core))
    turns = sum(a.isdigit() != b.isdigit() for a, b in zip(core, core[1:], strict=False))
    spread = min(len(set(core)), 24) // 3
    low = core.lower()
    out = [f"size{min(n, 48) // 4}", "mix" + "".join("01"[k] for k in kinds), f"turns{min(turns, 12) // 2}", f"spread{spread}", f"hexlike{n >= 12 and all(c in '0123456789abcdefABCDEF' for c in core)}"]
    out.append("both" + "".join("01"[k] for k in kinds[:3]) + f"{min(n, 48) // 8}{spread}{min(turns, 8) // 2}")
    if low in CUES:
        out.append("cue")
    if n == 0:
        out.append("mark" + word[:2])
    if "@" in word or "://" in word:
        out.append("address")
    if core[:4] in ("AKIA", "ghp_", "sk_l", "xoxb", "eyJh"):
        out.append("prefix")
    return out


#: Words of letters and closing marks.
PLAIN = re.compile(r"([a-z\u00df-\u00ff]*)[.,;:!?]*")


@cache
def _plain(n: int, kinds: int) -> tuple[str, ...]:
    """Features of a word of n lower-case letters of which 3 * kinds or little more differ."""
    out = (f"size{min(n, 48) // 4}", "mix0100", "turns0", f"spread{kinds}", "hexlikeFalse", f"both010{min(n, 48) // 8}{kinds}0")
    return out


def named_features(word: str) -> tuple[str, ...]:
    """word_features, by a short way for plain words, which are nearly all."""
    m = PLAIN.fullmatch(word)
    if m and (core := m[1]) and core not in CUES and not set(core) <= set("abcdef"):
        return _plain(min(len(core), 48), min(len(set(core)), 24) // 3)
    return tuple(word_features(word))


def features(word: str) -> tuple[list[int], list[int], list[int]]:
    """Slots of a word's features for itself, and as the word before and the word after another."""
    return slots(named_features(word))


def slots(names: tuple[str, ...]) -> tuple[list[int], list[int], list[int]]:
    return [_slot("w" + x) for x in names], [_slot("p" + x) for x in names], [_slot("n" + x) for x in names]


def file_features(text: str) -> list[int]:
    """Slots that hold for all words of a text: how much of it is digits, and whether it speaks of secrets."""
    digits = sum(map(text.count, "0123456789")) / max(1, len(text))
    low = text.lower()
    return [_slot(f"digits{min(int(digits * 50), 10)}"), _slot(f"cues{any(c in low for c in ('password', 'secret', 'token', 'api'))}")]


#: Made secrets are keys of five known formats and strings of other alphabets, lengths and separators.
KEYS = 8


def _random_secret(r: random.Random) -> str:
    kind = r.randrange(KEYS)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    if kind == 5:
        return "".join(r.choices(letters + "-_", k=r.randrange(16, 90)))
    if kind == 6:
        return r.choice("-_.").join("".join(r.choices(letters, k=r.randrange(8, 40))) for _ in range(r.randrange(2, 5)))
    if kind == 7:
        return "".join(r.choices(r.choice((letters[:26] + "234567", letters[26:52] + "0123456789", letters)), k=r.randrange(16, 60)))
    if kind == 0:
        return "".join(r.choices("0123456789abcdef", k=r.choice((32, 40, 64))))
    if kind == 1:
        return "ghp_" + "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=36))
    if kind == 2:
        return "AKIA" + "".join(r.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", k=16))
    if kind == 3:
        return "sk_live_" + "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=24))
    return "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=r.choice((20, 28, 40))))


def _random_plain(r: random.Random, words: list[str]) -> str:
    """What looks unlike a word and is no secret: addresses and compounds of the text's own words, times, prices and numbers."""
    core = [w.strip(".,;:!?\"'()").lower()[:12] or "x" for w in r.choices(words, k=5)]
    digits = lambda k: "".join(r.choices("0123456789", k=k))
    return (
        lambda: f"{r.choice(('http', 'https'))}://{core[0]}.{r.choice(('com', 'org', 'net'))}/{'/'.join(core[1 : r.randrange(1, 5)])}",
        lambda: f"{core[0]}.{core[1]}@{core[2]}.org",
        lambda: "".join(core[: r.randrange(2, 6)]).capitalize(),
        lambda: r.choice("-/_").join(core[: r.randrange(2, 5)]),
        lambda: f"{digits(2)}:{digits(2)}",
        lambda: f"{digits(4)}-{digits(2)}-{digits(2)}",
        lambda: f"{digits(r.randrange(1, 4))},{digits(3)}.{digits(2)}",
        lambda: digits(r.randrange(1, 17)),
    )[r.randrange(8)]()


def training_rows(text: str, seed: int = 5, span: int = 48) -> list[tuple[list[str], list[int], list[int]]]:
    """Windows of a text's words with labels and file features: its first base match or a plain window, and a made secret among them.

    The whole text is looked through; what is made up follows from the text and the seed alone.
    """
    r = random.Random(seed ^ int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little"))
    words = [(m.start(), m.end()) for m in WORD.finditer(text)]
    if not words:
        return []
    whole, marks = file_features(text), np.zeros(len(words), int)
    starts, ends = np.array(words).T
    for kind, a, b in base_spans(text):
        if kind == "assign":
            a = BASE[0][1].match(text, a).start(2)
        inside = np.arange(np.searchsorted(ends, a, "right"), np.searchsorted(starts, b))
        marks[inside] = INSIDE
        marks[inside[:1]] = BEGIN
    at = int(np.flatnonzero(marks)[0]) if marks.any() else r.randrange(len(words))
    lo = max(0, at - span // 2)
    part, own = [text[s:e] for s, e in words[lo : lo + span]], marks[lo : lo + span].tolist()
    rows = [(part, own, whole)]
    lead = r.choice((["password", "="], ["token:"], ["api", "key", "is"], ["bearer"], ["secret", ":"], ["pwd", "="], ["access", "key"], []))
    two = [_random_secret(r) for _ in range(r.choice((1, 1, 1, 2)))]
    at = r.randrange(len(part) + 1)
    if not any(own):
        for _ in range(r.randrange(4)):
            k = r.randrange(len(part) + 1)
            part, own = [*part[:k], _random_plain(r, part), *part[k:]], [*own[:k], OUT, *own[k:]]
        rows.append((part[:at] + lead + two + part[at:], own[:at] + [OUT] * len(lead) + [BEGIN] + [INSIDE] * (len(two) - 1) + own[at:], whole))
    return rows


class Crf:
    """Weights of features (SIZE x 3), of label pairs (3 x 3) and of a text's first label (3)."""

    def __init__(self, w: np.ndarray, pair: np.ndarray, first: np.ndarray):
        self.w, self.pair, self.first = w, pair, first

    @staticmethod
    def train(rows: list[tuple[list[str], list[int], list[int]]], rounds: int = 60, rate: float = 0.3, decay: float = 1e-4) -> Crf:
        """Full-batch Adagrad on the conditional likelihood; the gradient is observed minus expected counts by forward-backward."""
        if not rows:
            return Crf(np.zeros((SIZE, 3)), np.zeros((3, 3)), np.zeros(3))
        n, length = len(rows), max(len(r[0]) for r in rows)
        place, slot = [], []
        gold, real = np.zeros((n, length), int), np.zeros((n, length), bool)
        for i, (words, marks, whole) in enumerate(rows):
            fs = [features(x) for x in words]
            gold[i, : len(words)], real[i, : len(words)] = marks, True
            for j in range(len(words)):
                s = fs[j][0] + (fs[j - 1][1] if j else [_slot("pstart")]) + (fs[j + 1][2] if j + 1 < len(words) else [_slot("nend")]) + whole
                place += [i * length + j] * len(s)
                slot += s
        place, slot = np.array(place), np.array(slot)
        crf = Crf(np.zeros((SIZE, 3)), np.zeros((3, 3)), np.zeros(3))
        past = [np.full(x.shape, 1e-8) for x in (crf.w, crf.pair, crf.first)]
        hot = np.eye(3)[gold] * real[:, :, None]
        for _ in range(rounds):
            e = np.stack([np.bincount(place, crf.w[slot, k], n * length) for k in range(3)], axis=1).reshape(n, length, 3)
            a, b = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            a[:, 0] = crf.first + e[:, 0]
            for j in range(1, length):
                new = np.logaddexp.reduce(a[:, j - 1, :, None] + crf.pair, axis=1) + e[:, j]
                a[:, j] = np.where(real[:, j, None], new, a[:, j - 1])
            for j in range(length - 2, -1, -1):
                new = np.logaddexp.reduce(crf.pair + (e[:, j + 1] + b[:, j + 1])[:, None, :], axis=2)
                b[:, j] = np.where(real[:, j + 1, None], new, 0)
            z = np.logaddexp.reduce(a[:, -1], axis=1)
            p = np.exp(a + b - z[:, None, None]) * real[:, :, None]
            miss = (hot - p).reshape(-1, 3)
            grad_w = np.stack([np.bincount(slot, miss[place, k], SIZE) for k in range(3)], axis=1) / n - decay * crf.w
            both = real[:, 1:, None, None] * np.exp(a[:, :-1, :, None] + crf.pair + (e + b)[:, 1:, None, :] - z[:, None, None, None])
            grad_pair = (np.einsum("nta,ntb->ab", hot[:, :-1] * real[:, 1:, None], hot[:, 1:]) - both.sum((0, 1))) / n - decay * crf.pair
            grad_first = (hot[:, 0] - p[:, 0]).sum(0) / n - decay * crf.first
            for x, g, h in zip((crf.w, crf.pair, crf.first), (grad_w, grad_pair, grad_first), past, strict=True):
                h += g * g
                x += rate * g / np.sqrt(h)
        return crf

    def viterbi(self, e: np.ndarray, first: np.ndarray) -> list[int]:
        best, back = first + e[0], []
        for row in e[1:]:
            score = best[:, None] + self.pair
            back.append(score.argmax(0))
            best = score.max(0) + row
        out = [int(best.argmax())]
        for k in reversed(back):
            out.append(int(k[out[-1]]))
        return out[::-1]

    @property
    def sure(self) -> float:
        """A word whose own score for OUT leads by more than this is OUT on the best path, whatever its neighbours are."""
        ways = [self.pair[a, x] + self.pair[x, b] - self.pair[a, OUT] - self.pair[OUT, b] for a in range(3) for b in range(3) for x in range(3)]
        ends = [self.pair[a, x] - self.pair[a, OUT] for a in range(3) for x in range(3)] + [self.first[x] + self.pair[x, b] - self.first[OUT] - self.pair[OUT, b] for b in range(3) for x in range(3)] + (self.first - self.first[OUT]).tolist()
        return max(ways + ends)


class Tagger:
    """Finds the words of secrets in many texts: per distinct word scores, then Viterbi on the stretches that aren't surely OUT."""

    def __init__(self, crf: Crf):
        self.crf, self.known = crf, {}
        self.edge = crf.w[_slot("pstart")], crf.w[_slot("nend")]
        self.classes: dict[tuple[str, ...], int] = {}
        self.table: list[np.ndarray] = []

    def _class(self, word: str) -> int:
        names = named_features(word)
        k = self.classes.get(names)
        if k is None:
            k = self.classes[names] = len(self.table)
            self.table.append(np.stack([self.crf.w[s].sum(0) for s in slots(names)]))
        return k

    def _scores(self, words: pa.Array) -> np.ndarray:
        """own, before and after scores of distinct words; words with the same features are a class."""
        if len(self.known) > 1 << 20:
            self.known = {}
        known, at = self.known, np.zeros(len(words), int)
        for i, w in enumerate(words.to_pylist()):
            k = known.get(w)
            if k is None:
                k = known[w] = self._class(w)
            at[i] = k
        return np.stack(self.table)[at]

    def hits(self, bounds: np.ndarray, words: pa.Array, texts: list[str | None]) -> dict[int, list[tuple[int, int]]]:
        """By text: (first, last word) of each tagged secret."""
        n = len(words)
        if not n:
            return {}
        d = words.dictionary_encode()
        score, code = self._scores(d.dictionary), d.indices.to_numpy()
        e = score[code, 0]
        e[1:] += score[code[:-1], 1]
        e[:-1] += score[code[1:], 2]
        some = np.flatnonzero(np.diff(bounds) > 0)
        first, last = bounds[some], bounds[some + 1] - 1
        e[first] += self.edge[0] - np.where((first > 0)[:, None], score[code[first - 1], 1], 0)
        e[last] += self.edge[1] - np.where((last + 1 < n)[:, None], score[code[np.minimum(last + 1, n - 1)], 2], 0)
        whole = np.array([self.crf.w[file_features(texts[i] or "")].sum(0) for i in some])
        owner = np.repeat(np.arange(len(some)), np.diff(bounds)[some])
        e += whole[owner]
        open_ = e[:, OUT] - e[:, 1:].max(1) <= self.crf.sure
        out: dict[int, list[tuple[int, int]]] = {}
        at = np.flatnonzero(open_)
        if not len(at):
            return out
        cut = np.flatnonzero((np.diff(at) > 1) | (owner[at[1:]] != owner[at[:-1]])) + 1
        for part in np.split(at, cut):
            a, b, doc = int(part[0]), int(part[-1]), int(owner[part[0]])
            lo, hi = a - (a > first[doc]), b + (b < last[doc])
            way = self.crf.viterbi(e[lo : hi + 1], self.crf.first if lo == first[doc] else np.array([0.0, -1e9, -1e9]))
            k = 0
            while k < len(way):
                if way[k] == OUT:
                    k += 1
                    continue
                m = k + 1
                while m < len(way) and way[m] == INSIDE:
                    m += 1
                out.setdefault(int(some[doc]), []).append((lo + k - int(first[doc]), lo + m - 1 - int(first[doc])))
                k = m
        return out


def train(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> Crf:
    """A model fitted on windows of at most `sample` whole texts (those of least hash, each once): base matches, and secrets made up among words."""
    rows = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    least = [r.h for r in rows.select("h").distinct().orderBy("h").limit(sample).collect()]
    if not least:
        return Crf.train([])
    # one text of each hash; tasks look it through and send a few windows of it
    found = rows.filter(F.col("h") <= least[-1]).groupBy("h").agg(F.min("text").alias("text"))

    @tidy
    def run(batches):
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                made = training_rows(text)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(made), pa.int64()), pa.array(range(len(made)), pa.int32()), *(pa.array([r[k] for r in made], pa.list_(kind)) for k, kind in enumerate((pa.string(), pa.int32(), pa.int32())))], names=["h", "k", "words", "marks", "whole"])

    windows = found.mapInArrow(run, "h long, k int, words array<string>, marks array<int>, whole array<int>").collect()
    return Crf.train([(r.words, r.marks, r.whole) for r in sorted(windows, key=lambda r: (r.h, r.k))])


def scan(docs: DataFrame, crf: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_crf, base (the base spans as a string) and spans (all spans), a row per input row.

    Spans are kind:start:end in code points, end exclusive, comma-joined. The model adds spans of its own; of one
    that meets base spans the words beside them are added. Base spans all stay. Null and empty texts have none; repeated rows are scanned one by one; an empty table gives an empty
    result; other columns are not read. Every word of every text is scored; there is no shuffle.
    """

    @tidy

    def run(batches):
        tagger = Tagger(crf)
        for batch in batches:
            for part in slices(batch):
                rows = found_spans(tagger, part.column("text"))
                counts = [[sum(x[0] == k for x in every) for _, every in rows] for k in KINDS]
                texts = [[",".join(f"{k}:{s}:{e}" for k, s, e in row[j]) for row in rows] for j in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), *(pa.array(c, pa.string()) for c in texts)], names=["doc_id", "n_assign", "n_access", "n_hex", "n_crf", "base", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_crf long, base string, spans string")


STRIP = re.compile(r"[A-Za-z0-9+/_.=-](?:.*[A-Za-z0-9+/_=-])?", re.S)


def beside(text: str, start: int, end: int, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """What a span of the model adds to the base spans: itself, stripped, where it meets none; else the words left of it, each stripped."""
    met = [(s, e) for _, s, e in base if s < end and e > start]
    if not met:
        m = STRIP.search(text, start, end)
        return [(m.start(), m.end()) if m else (start, end)]
    out, at = [], start
    for s, e in [*met, (end, end)]:
        for w in WORD.finditer(text, at, max(at, s)):
            if m := STRIP.search(text, w.start(), w.end()):
                out.append((m.start(), m.end()))
        at = max(at, e)
    return out


def found_spans(tagger: Tagger, column: pa.Array) -> list[tuple[list, list]]:
    """Base spans and all spans of each text of an Arrow column."""
    texts = column.to_pylist()
    hints = [pc.match_substring_regex(column, p) for p in HINTS]
    maybe = pc.fill_null(pc.or_(pc.or_(hints[0], hints[1]), hints[2]), False).to_pylist()
    bounds, words = split_words(column)
    tagged = tagger.hits(bounds, words, texts)
    rows = []
    for i, text in enumerate(texts):
        base, added = base_spans(text) if maybe[i] else [], []
        if i in tagged:
            at = [(m.start(), m.end()) for m in WORD.finditer(text)]
            for a, b in tagged[i]:
                added += [("crf", s, e) for s, e in beside(text, at[a][0], at[b][1], base)]
        rows.append((base, sorted(base + added, key=lambda x: (x[1], KINDS.index(x[0])))))
    return rows


def redact_documents(docs: DataFrame, crf: Crf, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with every found span replaced by a mark, and their number of characters set anew; all other columns pass.

    Rows without spans, null and empty texts pass unchanged.
    """
    names = docs.columns

    @tidy

    def run(batches):
        tagger = Tagger(crf)
        for batch in batches:
            for part in slices(batch, text_col):
                column = part.column(text_col)
                spans = found_spans(tagger, column)
                if not any(every for _, every in spans):
                    yield part
                    continue
                texts = [redact(t, ",".join(f"{k}:{s}:{e}" for k, s, e in every)) for t, (_, every) in zip(column.to_pylist(), spans, strict=True)]
                new = {text_col: pa.array(texts, part.schema.field(text_col).type)}
                if size_col in names:
                    old = part.column(size_col).to_pylist()
                    new[size_col] = pa.array([len(t) if every else n for t, n, (_, every) in zip(texts, old, spans, strict=True)], part.schema.field(size_col).type)
                yield pa.RecordBatch.from_arrays([new.get(c, part.column(c)) for c in names], schema=part.schema)

    return docs.mapInArrow(run, docs.schema)


def redact(text: str | None, spans: str, mark: str = "[secret]") -> str | None:
    """The text with each stretch of spans replaced by a mark."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s, e in sorted(tuple(map(int, x.split(":")[1:])) for x in spans.split(",")):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])


def digest(docs: DataFrame) -> DataFrame:
    found = scan(docs, train(docs))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_crf")
