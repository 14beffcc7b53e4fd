"""License scan with a positional index of rare template words.

The templates are three dozen standard licence texts and notices.  The inverse document frequency
of each of their words comes from all documents.  The index has, for each word, its
postings (template, position) in those templates of whose rarest words it is one:
a template is posted under as many of its rarest words that no text in which
``LEAST_SCORE`` of its words stand in place can be without one of them.  A text
looks up its own words in the index, highest IDF first; each posting names an
alignment (template, text position - template position), votes within ``SLACK``
places are added up, and alignments with enough votes are checked word by word.
A template counts only if its mandatory key phrases stand in the aligned stretch.
The work follows the postings found, not the number of templates.

Beside this the fixed base phrases are located at every place.

Defined results: null and empty texts have no words and no labels; very long
texts are scanned whole; repeated rows give equal results; ids may be null and of
any type; an empty table gives an empty result; extra columns are ignored.  Of
equal scores of a template the first place counts; labels are sorted.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satspan.llm.license_texts import TEMPLATES, Template
from satspan.llm.textbytes import pieces, text_bytes, word_spans

_NOT_WORD = np.zeros(256, dtype=bool)
_NOT_WORD[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True
#: Bytes that end a word once A-Z are lower-cased.
_NOT_WORD_ANY_CASE = _NOT_WORD.copy()
_NOT_WORD_ANY_CASE[65:91] = False
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))

#: Base phrases and labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))


#: The share of template words that must stand in place.
LEAST_SCORE = 0.7
#: Bytes of text that are worked on at once.
PIECE = 1_000_000
#: A shift of the words by this many places still counts as in place.
SLACK = 2


class Index:
    """Postings of the templates' rarest words: word -> [(template, position)].

    Of a template's n places, as many are posted (rarest words first, all places
    of a word) as leave fewer than ``LEAST_SCORE * n`` others, so every match has
    posted places; ``least`` says how many it has at least.
    """

    def __init__(self, templates: tuple[Template, ...], idf: dict[str, float]) -> None:
        self.templates, self.idf = templates, idf
        self.words = [t.text.split() for t in templates]
        self.postings: dict[str, list[tuple[int, int]]] = {}
        self.least: list[int] = []
        for k, words in enumerate(self.words):
            missing = len(words) - math.ceil(LEAST_SCORE * len(words) - 1e-9)
            posted = 0
            for w in sorted(set(words), key=lambda w: (-idf.get(w, 0.0), w)):
                if posted > 2 * missing:
                    break
                places = [at for at, x in enumerate(words) if x == w]
                self.postings.setdefault(w, []).extend((k, at) for at in places)
                posted += len(places)
            self.least.append(max(1, posted - missing))

    def candidates(self, places: dict[str, list[int]]) -> list[tuple[int, int]]:
        """Alignments (template, shift) with enough votes; ``places`` has the
        positions of index words in a text.

        Words are looked up from the highest IDF down.  What a template can still
        get is the number of its places under the words to come, so one that
        cannot reach its least votes is dropped, and the rest of the words (the
        common ones, with the most places) are not looked up once all are."""
        held = sorted((w for w in places if w in self.postings), key=lambda w: (-self.idf.get(w, 0.0), w))
        left = Counter(k for w in held for k, _ in self.postings[w])
        votes: dict[tuple[int, int], int] = {}
        top: Counter[int] = Counter()
        live = {k for k, n in left.items() if n >= self.least[k]}
        for w in held:
            if not live:
                break
            for k, at in self.postings[w]:
                left[k] -= 1
                if k not in live:
                    continue
                for shift in {p - at + d for p in places[w] for d in range(-SLACK, SLACK + 1)}:
                    n = votes[k, shift] = votes.get((k, shift), 0) + 1
                    top[k] = max(top[k], n)
            live = {k for k in live if top[k] + left[k] >= self.least[k] and left[k]}
        return sorted(x for x, n in votes.items() if n >= self.least[x[0]])

    def match(self, words: list[str], places: dict[str, list[int]]) -> list[tuple[str, float, int, int]]:
        """(label, score, first, last word) of the templates found in a text."""
        best: dict[int, tuple[float, int]] = {}
        for k, shift in self.candidates(places):
            score = in_place(self.words[k], words, shift) / len(self.words[k])
            if score >= LEAST_SCORE and (k not in best or score > best[k][0]) and self._keys(k, words, shift):
                best[k] = (score, shift)
        return [
            (self.templates[k].label, score, max(0, shift), min(len(words), shift + len(self.words[k])) - 1)
            for k, (score, shift) in sorted(best.items())
        ]

    def _keys(self, k: int, words: list[str], shift: int) -> bool:
        stretch = " " + " ".join(words[max(0, shift - SLACK) : max(0, shift + len(self.words[k]) + SLACK)]) + " "
        return all(f" {key} " in stretch for key in self.templates[k].keys)


def in_place(template: list[str], words: list[str], shift: int) -> int:
    """Words of the template that stand at their place, or near it."""
    return sum(w in words[max(0, shift + at - SLACK) : max(0, shift + at + SLACK + 1)] for at, w in enumerate(template))


def _spotted(part: pa.RecordBatch, wanted: dict[bytes, str]) -> Iterator[tuple[int, int, dict[str, list[int]], object]]:
    """Per text: its number, word count and the positions of wanted words.

    Words are compared by length and first bytes in array form first, so only
    likely ones become Python objects.
    """
    column = part.column(1)
    data, at = text_bytes(column)
    start, end, doc = word_spans(data, at, _NOT_WORD_ANY_CASE)
    lower = np.frombuffer(data.tobytes().translate(_LOWER), dtype=np.uint8)
    raw = lower.tobytes()
    padded = np.concatenate([lower, np.zeros(3, np.uint8)]).astype(np.uint32)
    head = (padded[start] | padded[start + 1] << 8 | padded[start + 2] << 16) if len(start) else np.zeros(0, np.uint32)
    head = np.where(end - start == 1, head & 0xFF, np.where(end - start == 2, head & 0xFFFF, head))
    code = head.astype(np.int64) << 16 | np.minimum(end - start, 0xFFFF)
    codes = np.unique([int.from_bytes(w[:3], "little") << 16 | len(w) for w in wanted])
    slot = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
    likely = np.flatnonzero(codes[slot] == code)
    first = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(column)))])
    places: dict[int, dict[str, list[int]]] = {}
    for i, s, e, d in zip(likely.tolist(), start[likely].tolist(), end[likely].tolist(), doc[likely].tolist()):
        word = wanted.get(raw[s:e])
        if word is not None:
            places.setdefault(d, {}).setdefault(word, []).append(i - int(first[d]))
    for d in range(len(column)):
        a, b = int(first[d]), int(first[d + 1])
        yield d, b - a, places.get(d, {}), lambda a=a, b=b: [raw[s:e].decode() for s, e in zip(start[a:b].tolist(), end[a:b].tolist())]


_PHRASES = tuple((tuple(p.split()), label) for p, label in BASE)


def base_places(places: dict[str, list[int]]) -> list[tuple[int, str]]:
    """(first word, label) of every place where a base phrase stands."""
    found = []
    for words, label in _PHRASES:
        if all(w in places for w in words):
            rest = [set(places[w]) for w in words[1:]]
            found += [(p, label) for p in places[words[0]] if all(p + j + 1 in r for j, r in enumerate(rest))]
    return found


def document_frequency(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Rows, and rows with each of the given words, over all documents."""
    wanted = {w.encode(): w for w in words}

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, found = 0, Counter()
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                for _, _, places, _ in _spotted(part, wanted):
                    n += 1
                    found.update(places.keys())
        yield pa.RecordBatch.from_pydict({"word": ["", *found], "n": [n, *found.values()]})

    rows = docs.select("doc_id", "text").mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    found = {r["word"]: r["n"] for r in rows.collect()}  # one row per index word
    return found.pop("", 0) or 0, found


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per row the word count, base places and labels, and the templates found."""
    known = sorted({w for t in templates for w in t.text.split()})
    n, found = document_frequency(docs, known)
    index = Index(templates, {w: math.log((n + 1) / (found.get(w, 0) + 1)) for w in known})
    wanted = {w.encode(): w for w in {*index.postings, *(w for words, _ in _PHRASES for w in words)}}
    shared = docs.sparkSession.sparkContext.broadcast((index, wanted))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, wanted = shared.value
        for batch in batches:
            for part in pieces(batch, "text", PIECE):
                rows = []
                for _, n_words, places, words in _spotted(part, wanted):
                    base = base_places(places)
                    labels = {x for _, x in base}
                    matched = index.match(words(), places) if index.candidates(places) else []
                    starts = [p for p, _ in base]
                    rows.append((
                        n_words, len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)),
                        ",".join(sorted(labels | {m[0] for m in matched})), float(max((m[1] for m in matched), default=0.0)),
                        [f"{m[0]}:{m[2]}:{m[3]}" for m in matched],
                    ))
                cols = list(zip(*rows)) if rows else [()] * 8
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.string())]
                names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return docs.select("doc_id", "text").mapInArrow(
        scanned,
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_base long, first_word long, last_word long, base_labels string,"
        " labels string, score double, places array<string>",
    )
