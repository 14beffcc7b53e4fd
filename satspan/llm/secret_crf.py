"""Secret scan: fixed patterns, and a linear-chain conditional random field.

The field tags the tokens of a text (runs of letters and digits, and runs of other
non-blank bytes) as secret begin (B), inside (I) or outside (O) from their shape,
the words around them on the line and features of the whole file; the chain is the
whole text.  Inside follows a begin or an inside that it touches, so no secret
holds a blank.

Features are small numbers that are found for all tokens of a batch of texts by
array operations, so every token gets its three scores.  Viterbi then runs where a
tag other than O can win at all: a blank-free run whose tokens could not gain even
with the best transitions is O in the best path, and the chain decomposes there.
The result is that of the full chain.

The weights are trained here: by gradient ascent of the likelihood on windows of
``WINDOW`` tokens, ``WINDOWS`` at most with and as many without a secret, from a
bounded sample (about ``SAMPLE`` distinct texts, chosen by a hash) labelled by the
fixed patterns, and on seeded made-up lines in other known formats.

Defined results: null and empty texts have no spans; very long texts are
scanned whole; repeated rows give equal results; ids may be null and of any type;
an empty table gives an empty result (the field is then trained on made-up lines
alone); extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satspan.llm.textbytes import _BLANK, U, pieces, text_bytes, word_hashes, word_spans

#: The base patterns, with the least length of their value.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ("assign", "access", "hex", "crf")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

#: Texts of the training sample, windows of each kind, and made-up lines.
SAMPLE = 2000
WINDOWS = 2000
WINDOW = 32
MADE_UP = 2000
STEPS = 40
TAGS = 3  # O, B, I
#: Bytes of a secret that the field finds.
LEAST_RUN = 8
#: Bytes of text that are worked on at once.
PIECE = 1_000_000

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_NEAR = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "auth", "authorization", "bearer", "credential", "credentials", "private")


def base_spans(text: str, lower: bytes, long_run: bool) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the patterns; ``lower`` and ``long_run``
    say cheaply which patterns can occur."""
    found = []
    if any(k in lower for k in KEYWORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"akia" in lower:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if long_run:
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def _flags(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGIT, _UPPER, _SMALL = _flags("0123456789"), _flags(_LETTERS.upper()), _flags(_LETTERS)
_HIGH = np.arange(256) >= 128
_WORD = _DIGIT | _UPPER | _SMALL | _HIGH
_HEX, _VOWEL, _CODE = _flags("0123456789abcdef"), _flags("aeiouyAEIOUY"), _flags("={};<>()\"'")
#: Class of each byte, for changes within a token.
_CLASS = (_DIGIT + 2 * _UPPER + 3 * _SMALL).astype(np.uint8)
_HASHES = 2048
_NEAR_TEXT = np.frombuffer(" ".join(_NEAR).encode(), np.uint8)
_NEAR_KEYS = word_hashes(_NEAR_TEXT, *word_spans(_NEAR_TEXT, np.array([0, len(_NEAR_TEXT)]))[:2])
#: Sizes of the feature groups, in the order of ``tokens_of``.
GROUPS = (17 * 17, 17 * 9, 17 * 18, 9 * 17, 2 * 17, 17 * 81, 2 * _HASHES, 2 * _HASHES, 2 * _HASHES, 4 * 17, 16, 16, 2 * 17, 9 * 17, 1)
FIRST = np.concatenate([[0], np.cumsum(GROUPS)])


class Tokens(NamedTuple):
    start: np.ndarray  # byte of the batch
    end: np.ndarray
    doc: np.ndarray
    run: np.ndarray  # number of the blank-free run
    touches: np.ndarray  # the token before ends where this one starts
    begins: np.ndarray  # may be B
    goes_on: np.ndarray  # may be I
    features: np.ndarray  # feature numbers, a row per token


def tokens_of(data: np.ndarray, at: np.ndarray) -> Tokens:
    """The tokens of some texts and their features."""
    word = _WORD[data]
    kind = np.where(_BLANK[data], 0, np.where(word, 1, 2)).astype(np.uint8)
    new = np.ones(len(data), dtype=bool)
    new[1:] = kind[1:] != kind[:-1]
    new[at[:-1][at[:-1] < len(data)]] = True
    edge = np.flatnonzero(new)
    last = np.append(edge[1:], len(data))
    own = kind[edge] > 0
    start, end = edge[own], last[own]
    n = len(start)
    doc = np.searchsorted(at, start, side="right") - 1
    touches = np.zeros(n, dtype=bool)
    touches[1:] = (start[1:] == end[:-1]) & (doc[1:] == doc[:-1])
    run = np.cumsum(~touches) - 1
    line = np.cumsum(data == 10, dtype=np.int32)
    line = line[start] if n else line[:0]
    same = lambda k: np.concatenate([np.zeros(min(k, n), dtype=bool), (line[k:] == line[: n - k]) & (doc[k:] == doc[: n - k])]) if n > k else np.zeros(n, dtype=bool)

    def count(flag: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(flag, out=total[1:], dtype=np.int32)
        return total

    def per(flag: np.ndarray) -> np.ndarray:
        total = count(flag)
        return total[end] - total[start]

    size = end - start
    digits, upper, small, high = (per(f[data]) for f in (_DIGIT, _UPPER, _SMALL, _HIGH))
    flip = np.zeros(len(data), dtype=bool)
    flip[1:] = (_CLASS[data[1:]] != _CLASS[data[:-1]]) & ~new[1:]
    flips, vowels = per(flip), per(_VOWEL[data])
    is_word = word[start] if n else word[:0]
    mask = np.where(is_word, (digits > 0) + 2 * (upper > 0) + 4 * (small > 0) + 8 * (high > 0), 16)
    length, eight = np.minimum(size, 64) // 4, np.minimum(size, 64) // 8
    share = lambda x: 8 * x // np.maximum(size, 1)
    key = word_hashes(data, start, end)
    hashed = (key % U(_HASHES)).astype(np.int64)
    near = np.isin(key, _NEAR_KEYS)
    before = np.zeros(n, dtype=bool)
    for k in range(1, min(5, n)):
        before[k:] |= near[: n - k] & same(k)[k:]
    # The last word before, at most three tokens back.
    prior = np.full(n, 0)
    for k in (3, 2, 1):
        if n > k:
            hit = np.flatnonzero(same(k)[k:] & is_word[: n - k]) + k
            prior[hit] = hashed[hit - k] % (_HASHES - 1) + 1
    one = same(1)
    left = np.where(one, np.roll(hashed, 1) % (_HASHES - 1) + 1, 0)
    right = np.zeros(n, dtype=np.int64)
    right[:-1] = np.where(one[1:], hashed[1:] % (_HASHES - 1) + 1, 0)
    followed = np.append(touches[1:], False) if n else touches
    long = (size >= 8).astype(np.int64)
    bytes_of = np.diff(at)
    of_file = lambda flag: np.minimum(7, np.log2(1 + 1000 * np.diff(count(flag)[at]) / np.maximum(bytes_of, 1))).astype(np.int64)[doc]
    run_size = np.bincount(run, size) if n else np.zeros(0)
    groups = (
        mask * 17 + length, mask * 9 + share(flips), mask * 18 + share(digits) * 2 + (size >= 16), share(vowels) * 17 + length,
        (size == per(_HEX[data])) * 17 + length, mask * 81 + share(flips) * 9 + eight, long * _HASHES + prior, touches * _HASHES + left,
        followed * _HASHES + right, (touches + 2 * followed) * 17 + mask, of_file(_DIGIT[data]) * 2 + long, of_file(_CODE[data]) * 2 + long,
        before * 17 + length, (np.minimum(run_size[run], 64) // 8).astype(np.int64) * 17 + mask, np.zeros(n, dtype=np.int64),
    )
    features = np.empty((n, len(GROUPS)), dtype=np.int32)
    for k, group in enumerate(groups):
        features[:, k] = group + FIRST[k]
    return Tokens(start, end, doc, run, touches, is_word & (high == 0) & (size >= 2), touches & (high == 0), features)


class Field:
    """Weights of the chain: a row per feature and a transition matrix."""

    def __init__(self, emission: np.ndarray | None = None, transition: np.ndarray | None = None) -> None:
        self.emission = np.zeros((FIRST[-1], TAGS)) if emission is None else emission
        self.transition = np.zeros((TAGS, TAGS)) if transition is None else transition.copy()
        self.transition[0, 2] = -np.inf  # inside follows begin or inside only

    def scores(self, features: np.ndarray, begins: np.ndarray, goes_on: np.ndarray) -> np.ndarray:
        s = np.zeros((*features.shape[:-1], TAGS))
        for k in range(features.shape[-1]):
            s += self.emission[features[..., k]]
        s[~begins, 1], s[~goes_on, 2] = -np.inf, -np.inf
        return s

    def viterbi(self, s: np.ndarray) -> list[int]:
        """The best tags between two O; ties go to the smaller tag."""
        best, back = s[0] + self.transition[0], []
        for row in s[1:]:
            step = best[:, None] + self.transition
            back.append(step.argmax(0))
            best = step.max(0) + row
        tags = [int((best + self.transition[:, 0]).argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def decode(self, t: Tokens) -> Iterator[tuple[int, int]]:
        """First and last token of the secrets of some texts."""
        if not len(t.start):
            return
        s = self.scores(t.features, t.begins, t.goes_on)
        finite = self.transition[np.isfinite(self.transition)]
        slack = max(0.0, float(finite.max() - self.transition[0, 0]))
        gain = np.maximum(s[:, 1], s[:, 2]) - s[:, 0] + 2 * slack
        open_ = np.zeros(int(t.run[-1]) + 1, dtype=bool)
        open_[t.run[gain > 0]] = True
        mine = np.flatnonzero(open_[t.run])
        # Neighbouring runs of one text that are open are decoded together.
        cut = np.flatnonzero((np.diff(mine) > 1) | (np.diff(t.doc[mine]) > 0)) + 1
        for group in np.split(mine, cut):
            if not len(group):
                continue
            begin = None
            for i, tag in zip([*group.tolist(), -1], [*self.viterbi(s[group]), 0]):
                if tag != 2 and begin is not None:
                    yield begin, last
                    begin = None
                if tag == 1:
                    begin = i
                last = i

    def train(self, features: np.ndarray, begins: np.ndarray, goes_on: np.ndarray, tags: np.ndarray, inside: np.ndarray, steps: int) -> None:
        """Gradient ascent (with a step size per weight) of the mean log
        likelihood of windows; ``inside`` marks their tokens."""
        w, size = tags.shape
        square, square_t = np.full(self.emission.shape, 1e-3), np.full((TAGS, TAGS), 1e-3)
        fixed = np.isfinite(self.transition)
        low = lambda x: np.where(np.isfinite(x), x, -1e9)
        flat = features[inside].reshape(-1)
        for _ in range(steps):
            s = low(self.scores(features, begins, goes_on))
            s[~inside] = (0, -1e9, -1e9)
            move = low(self.transition)
            forward, backward = np.empty_like(s), np.zeros_like(s)
            forward[:, 0] = s[:, 0] + move[0]
            for i in range(1, size):
                forward[:, i] = np.logaddexp.reduce(forward[:, i - 1, :, None] + move, 1) + s[:, i]
            for i in range(size - 2, -1, -1):
                backward[:, i] = np.logaddexp.reduce(move + (s[:, i + 1] + backward[:, i + 1])[:, None, :], 2)
            total = np.logaddexp.reduce(forward[:, -1], 1)[:, None, None]
            error = -np.exp(forward + backward - total)
            np.put_along_axis(error, tags[..., None], np.take_along_axis(error, tags[..., None], 2) + 1, 2)
            per_token = error[inside]
            grad = np.stack([np.bincount(flat, np.repeat(per_token[:, k], features.shape[-1]), minlength=len(self.emission)) for k in range(TAGS)], 1)
            grad = grad / w - 2e-5 * self.emission
            pair = forward[:, :-1, :, None] + move + (s[:, 1:] + backward[:, 1:])[:, :, None, :] - total[..., None]
            grad_t = -np.exp(pair).sum((0, 1))
            np.add.at(grad_t, (tags[:, :-1], tags[:, 1:]), 1)
            grad_t /= w
            square += grad**2
            square_t += grad_t**2
            self.emission += 0.4 * grad / np.sqrt(square)
            self.transition[fixed] += (0.3 * grad_t / np.sqrt(square_t))[fixed]


def labels_of(text: bytes) -> list[tuple[int, int]]:
    """Bytes of the secrets that the fixed patterns name (of an assignment its
    value)."""
    found = [m.span(2) for m in _ASSIGN_BYTES.finditer(text) if m.end(2) - m.start(2) >= 8]
    found += [m.span() for m in _ACCESS_BYTES.finditer(text) if m.end() - m.start() >= 16]
    return found + [m.span() for m in _HEX_BYTES.finditer(text)]


_ASSIGN_BYTES = re.compile(ASSIGN.pattern.encode(), re.IGNORECASE)
_ACCESS_BYTES, _HEX_BYTES = re.compile(ACCESS.pattern.encode()), re.compile(HEX.pattern.encode())


def tagged(t: Tokens, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tags of the tokens that lie within spans (bytes of the batch)."""
    tags = np.zeros(len(t.start), dtype=np.int64)
    for s, e in spans:
        a, b = np.searchsorted(t.start, s), np.searchsorted(t.end, e, side="right")
        if a < b and t.begins[a] and not tags[a:b].any():
            tags[a:b] = 2
            tags[a] = 1
            tags[a + 1 : b][~t.goes_on[a + 1 : b]] = 0
    return tags


def windows(t: Tokens, tags: np.ndarray) -> Iterator[tuple[bool, np.ndarray]]:
    """Windows of consecutive tokens of one text as (has a secret, rows of
    features, may begin, may go on, tag); no window cuts a secret."""
    bounds = np.searchsorted(t.doc, np.arange(int(t.doc[-1]) + 2)) if len(t.doc) else []
    rows = np.column_stack([t.features, t.begins, t.goes_on, tags]).astype(np.int32) if len(t.doc) else None
    for low, high in zip(bounds[:-1], bounds[1:]):
        a = int(low)
        while a < high:
            b = min(a + WINDOW, int(high))
            while b < high and b > a + 1 and tags[b] == 2:
                b -= 1
            yield bool(tags[a:b].any()), rows[a:b]
            a = b


def _made_up(n: int, seed: int = 3) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Lines with a secret in a known format, or with something like one."""
    r = random.Random(seed)
    capital, digit = _LETTERS.upper(), "0123456789"
    mixed = _LETTERS + capital + digit
    some = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    word = lambda: "".join(r.choice("bcdfghklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 5))) + r.choice(("", "n", "s", "r"))
    secrets = (
        lambda: "ghp_" + some(mixed, 36), lambda: "AKIA" + some(capital + digit, 16), lambda: some("0123456789abcdef", r.choice((32, 40, 64))),
        lambda: some(mixed + "+/", 40), lambda: "eyJ" + ".".join(some(mixed, k) for k in (20, 40, 43)), lambda: "sk_live_" + some(mixed, 24),
        lambda: some(_LETTERS + capital, r.randint(20, 44)), lambda: some(mixed, r.randint(16, 48)), lambda: "glpat-" + some(mixed + "_", 20),
    )
    plain = (
        lambda: f"{word()}.{r.randint(1, 99)}@{word()}.example.com", lambda: f"https://{word()}.example.com/{word()}-{word()}/{r.randint(1, 99999)}",
        lambda: f"2026-{r.randint(10, 12)}-{r.randint(10, 28)}", lambda: f"{word()}{r.randint(1, 2030)}", lambda: str(r.randint(10**9, 10**16)),
        lambda: f"{r.randint(100, 999)}-{r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: word() + word().title() + word().title(),
        lambda: "_".join(word() for _ in range(4)), lambda: "/".join(word() for _ in range(5)), lambda: "".join(word() for _ in range(4)).upper(),
        lambda: "".join(word() for _ in range(5)), lambda: "".join(word() for _ in range(r.randint(4, 9))).title(),
    )
    for i in range(n):
        lead = " ".join(word() for _ in range(r.randint(0, 9)))
        lead += r.choice(("", " key:", " bearer", " token:", " secret =", " password is", " with", " auth=", " of", " ="))
        head, tail = r.choice((("", ""), ('"', '"'), ("key=", ""), ('"token":"', '",'), ("'", "';"), ("(", ")"), ("", "."), ("", ",")))
        line = (lead + " " + head).lstrip()
        own = (secrets[i // 2 % len(secrets)] if i % 2 else plain[i // 2 % len(plain)])()
        yield line + own + tail + " " + " ".join(word() for _ in range(r.randint(0, 9))), [(len(line), len(line) + len(own))] if i % 2 else []


def _windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "text", PIECE // 4):
            data, at = text_bytes(part.column(0))
            t = tokens_of(data, at)
            spans = [(int(a) + s, int(a) + e) for a, b in zip(at[:-1], at[1:]) for s, e in labels_of(data[a:b].tobytes())]
            found = list(windows(t, tagged(t, sorted(spans))))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.bool_()), pa.array([x.tobytes() for _, x in found], pa.binary())], ["has", "rows"])


def fit(docs: DataFrame, sample: int = SAMPLE, made_up: int = MADE_UP, steps: int = STEPS) -> Field:
    """Train on a bounded sample; deterministic for given rows."""
    texts = docs.select("text").where("text is not null")
    n = texts.count()
    some = texts.where(F.pmod(F.xxhash64("text"), F.lit(max(n, 1))) < sample).distinct()
    found = some.mapInArrow(_windows_of, "has boolean, rows binary").distinct()
    width = len(GROUPS) + 3
    rows: list[np.ndarray] = []
    found = found.withColumn("h", F.xxhash64("rows"))
    for has in (True, False):
        part = found.where(F.col("has") == has).orderBy("h", "rows").limit(WINDOWS).select("rows")  # WINDOWS of 2 kB
        rows += [np.frombuffer(x, np.int32).reshape(-1, width) for x in part.toArrow()["rows"].to_pylist()]
    for line, spans in _made_up(made_up):
        data = np.frombuffer(line.encode(), np.uint8)
        t = tokens_of(data, np.array([0, len(data)]))
        rows += [x for _, x in windows(t, tagged(t, spans))]
    field = Field()
    full = np.zeros((len(rows), max(map(len, rows), default=1), width), dtype=np.int32)
    inside = np.zeros(full.shape[:2], dtype=bool)
    for k, x in enumerate(rows):
        full[k, : len(x)], inside[k, : len(x)] = x, True
    field.train(full[..., :-3], full[..., -3] > 0, full[..., -2] > 0, full[..., -1].astype(np.int64), inside, steps)
    return field


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def field_spans(field: Field, data: np.ndarray, at: np.ndarray) -> dict[int, list[tuple[int, int]]]:
    """The field's secrets by text, in code points, ends exclusive."""
    t = tokens_of(data, at)
    point = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=point[1:])
    found: dict[int, list[tuple[int, int]]] = {}
    for a, b in field.decode(t):
        s, e, d = int(t.start[a]), int(t.end[b]), int(t.doc[a])
        if e - s >= LEAST_RUN:
            found.setdefault(d, []).append((int(point[s] - point[at[d]]), int(point[e] - point[at[d]])))
    return found


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and the number of
    spans that the field adds."""
    field = field or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.emission, field.transition))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Field(*shared.value)
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                data, at = text_bytes(part.column(1))
                raw = data.tobytes()
                lower = raw.translate(_LOWER)
                start, end, doc = word_spans(data, at)
                long_docs = set(doc[end - start >= 32].tolist())
                added = field_spans(model, data, at)
                rows = []
                for d in range(part.num_rows):
                    a, b = int(at[d]), int(at[d + 1])
                    spans = base_spans(raw[a:b].decode(), lower[a:b], d in long_docs)
                    more = [(s, 3, e) for s, e in added.get(d, ()) if not any(x < e and y > s for x, _, y in spans)]
                    count = Counter(k for _, k, _ in spans)
                    digest = hashlib.sha256(_joined(spans).encode()).hexdigest()
                    rows.append((count[0], count[1], count[2], digest, _joined(sorted(spans + more)), len(more)))
                cols = list(zip(*rows)) if rows else [()] * 6
                kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                    ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        scanned,
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_added long",
    )
