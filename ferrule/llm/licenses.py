"""License scans by MinHash bands over overlapping windows, with exact verification.

Templates and texts become sequences of ``NGRAM``-word shingles (words as in decontamination: lower-case, without ASCII
punctuation). A template of m shingles belongs to the class c, the least power of 2 that is m or more; longer ones than
``LONGEST`` are retrieved by their parts, each with a class of its own. For each class, windows of 2c shingles begin every
c shingles, so an occurrence lies in a window whole, and they are at least 1/5 alike. With ``BANDS`` bands of one MinHash
each, such a window and template (or part) share a band with a probability of 1 - (4/5)^40 = 0.9998.

Verification is always of the whole template, and exact: around the window, as far as the template reaches before and
after the part and half as far again as the whole template, it is found when ``containment`` of all its distinct shingles
are there; so a template may be stretched by inserted words to about twice its length. Of a shingle that occurs more than
once that place counts which is nearest to where the window puts it, so that copies one after another are places of their
own. A long template that has the containment has a part with it too, so one is retrieved. Then the words that tell a
license from others like it (``Template.required``: name and version, or a condition) must stand in the place word by word.

Of places that share words, the one counts that says most: a single license before a set of licenses that share a notice,
then the one with more of its shingles there. Another place gives way to it if half of its shingles are that one's too, so
neighbours that merely touch both stay.

Windows begin at a document's start and don't depend on what it is read with. Whole texts are scanned, in one pass and
without a shuffle. What goes to all tasks is bounded: more than ``MOST_WORDS`` words of templates are an error.

Defined results: null and empty texts hold nothing; repeated rows each give their rows; a document gives a row for each
place of a license. Of equal places the first template's counts. Templates shorter than ``NGRAM`` words are never found.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from xxhash import xxh3_64_intdigest

from ferrule.llm.common import by_bytes
from ferrule.llm.decontam import words_of
from ferrule.llm.license_texts import TEMPLATES, Template

NGRAM = 5
BANDS = 40
LONGEST = 64
#: Words of all templates: with some 80 bytes a word, and 16 KB for each class and band, their index has 100 MB at most.
MOST_WORDS = 1_000_000
NOTHING = np.iinfo(np.uint32).max


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.array(list(map(xxh3_64_intdigest, words)), dtype=np.uint64)


def shingles_of(w: np.ndarray) -> np.ndarray:
    """The hash of each ``NGRAM`` words in a row."""
    n = len(w) - NGRAM + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(NGRAM):
        h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    return h


def shingle_sequence(words: list[bytes]) -> np.ndarray:
    return shingles_of(word_hashes(words))


def stands_in(phrase: np.ndarray, words: np.ndarray) -> bool:
    """Whether a sequence is found in another one without gaps."""
    n = len(words) - len(phrase) + 1
    if n < 1:
        return False
    there = words[:n] == phrase[0]
    for i in range(1, len(phrase)):
        there &= words[i : i + n] == phrase[i]
    return bool(there.any())


class Templates:
    """Some templates' shingles, and the bands of their parts."""

    def __init__(self, templates: Sequence[Template | tuple], containment: float):
        rng = np.random.default_rng(5)
        self.a = rng.integers(1, 1 << 63, BANDS, dtype=np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
        self.containment = containment
        self.names: list[str] = []
        self.whole: list[np.ndarray] = []
        self.offset: list[np.ndarray] = []  # where each distinct shingle first is in its template
        parts: list[tuple[int, int, int]] = []  # template, and how far it reaches before and after the part
        shingles: list[np.ndarray] = []
        self.required: list[list[np.ndarray]] = []
        listed = [(Template(*x), words_of(x[1])) for x in templates]
        if sum(len(w) for _, w in listed) > MOST_WORDS:
            raise ValueError(f"templates of more than {MOST_WORDS} words in all")
        for template, words in listed:
            sequence = shingle_sequence(words)
            at = 0
            for part in np.array_split(sequence, -(-len(sequence) // LONGEST)) if len(sequence) else []:
                parts.append((len(self.names), at, len(sequence) - at - len(part)))
                shingles.append(np.unique(part))
                at += len(part)
            if len(sequence):
                self.names.append(template.license_id)
                self.required.append([word_hashes(words_of(phrase)) for phrase in template.required])
                distinct, at_first = np.unique(sequence, return_index=True)
                self.whole.append(distinct)
                self.offset.append(at_first)
        self.parts = parts
        sizes = [1 << (len(s) - 1).bit_length() for s in shingles]
        self.classes = {c: [t for t, size in enumerate(sizes) if size == c] for c in sorted(set(sizes))}
        least = [[int(self.minima(s, j).min()) for s in shingles] for j in range(BANDS)]
        self.bands, self.flags = {}, {}
        for c, members in self.classes.items():
            for j in range(BANDS):
                table: dict[int, list[int]] = {}
                for t in members:
                    table.setdefault(least[j][t], []).append(t)
                flags = np.zeros(1 << 16, bool)
                flags[np.array(list(table)) >> 16] = True
                self.bands[c, j], self.flags[c, j] = table, np.packbits(flags)

    def minima(self, hashes: np.ndarray, band: int) -> np.ndarray:
        return ((hashes * self.a[band] + self.b[band]) >> np.uint64(32)).astype(np.uint32)

    def chosen(self, t: int, own: np.ndarray, a: int, z: int, first: int, last: int) -> np.ndarray:
        """Places of a template's shingles in ``own[a:z]``, one for each that is there: the nearest to where it would be if
        the template were as the window from ``first`` to ``last`` has it."""
        whole = self.whole[t]
        which = np.minimum(np.searchsorted(whole, own[a:z]), len(whole) - 1)
        place = np.flatnonzero(whole[which] == own[a:z])
        which = which[place]
        place = place + a
        begins = place - self.offset[t][which]
        near = (place >= first) & (place < last)
        if not len(place):
            return place
        off = np.abs(begins - np.median(begins[near] if near.any() else begins))
        order = np.lexsort((place, off, which))
        return np.sort(place[order[np.append(True, which[order][1:] != which[order][:-1])]])

    def scan(self, texts: list[str | None]) -> list[tuple[int, str, float, int, int]]:
        """(text, license, containment, first word, word after the last) of each place of a license."""
        spelt = [word_hashes(words_of(t)) if t else np.zeros(0, np.uint64) for t in texts]
        sequences = [shingles_of(w) for w in spelt]
        # each text begins at a multiple of the largest class and has one such stretch of nothing after it
        room = [(-(-len(s) // LONGEST) + 1) * LONGEST for s in sequences]
        begin = np.cumsum([0, *room])
        stream, real = np.zeros(begin[-1], np.uint64), np.zeros(begin[-1], bool)
        for s, at in zip(sequences, begin, strict=False):
            stream[at : at + len(s)] = s
            real[at : at + len(s)] = True
        candidates: set[tuple[int, int, int]] = set()
        for j in range(BANDS):
            low = self.minima(stream, j)
            low[~real] = NOTHING
            size = 1
            for c in self.classes:
                while size < c:
                    low, size = low.reshape(-1, 2).min(axis=1), size * 2
                window = np.minimum(low, np.append(low[1:], NOTHING))
                flags = np.unpackbits(self.flags[c, j]).view(bool)
                for k in np.flatnonzero(flags[window >> 16]).tolist():
                    for t in self.bands[c, j].get(int(window[k]), ()):
                        candidates.add((c, k, t))
        places: dict[int, dict[tuple, np.ndarray]] = {}
        tried: set[tuple[int, int, int]] = set()
        for c, k, part in candidates:
            text = int(np.searchsorted(begin, k * c, "right")) - 1
            t, before, after = self.parts[part]
            whole, own, at = self.whole[t], sequences[text], k * c - int(begin[text])
            more = len(whole) + len(whole) // 2
            a, z = max(0, at - before - more), min(at + 2 * c + after + more, len(own))
            inside = self.chosen(t, own, a, z, at, at + 2 * c)
            if not len(inside) or (text, t, int(inside[0])) in tried:
                continue
            tried.add((text, t, int(inside[0])))
            share = len(inside) / len(whole)
            if share >= self.containment:
                words = spelt[text][max(0, int(inside[0]) - NGRAM) : int(inside[-1]) + 2 * NGRAM]
                if all(stands_in(phrase, words) for phrase in self.required[t]):
                    # a single license first, then what has most of its shingles, most of itself, and the shortest place
                    rank = (self.names[t].count("|"), -len(inside), -share, int(inside[-1] - inside[0]), int(inside[0]), t)
                    places.setdefault(text, {})[rank] = inside
        out = []
        for text, own_places in places.items():
            kept: list[tuple[int, np.ndarray]] = []
            for rank in sorted(own_places):
                inside, t = own_places[rank], rank[-1]
                meet = lambda other, u: self.names[u] == self.names[t] and inside[0] <= other[-1] and other[0] <= inside[-1] or 2 * np.isin(inside, other).sum() >= len(inside)  # noqa: B023, E731
                if not any(meet(other, u) for u, other in kept):
                    kept.append((t, inside))
                    out.append((text, self.names[t], round(-rank[2], 6), int(inside[0]), int(inside[-1]) + NGRAM))
        return sorted(out)


def license_scan(docs: DataFrame, templates: Sequence[Template | tuple] = TEMPLATES, containment: float = 0.8, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each place of a license in a document: doc_id, license_id, containment, start_word and end_word. The
    templates are whole licenses or notices, each of which counts by itself; where a notice can mean several licenses, and
    nothing in the place tells which, license_id has all of them, parted by |."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("license_id", T.StringType()), T.StructField("containment", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType())])
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates, containment))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            if found := shared.value.scan(batch.column(1).to_pylist()):
                cols = list(zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0])), *(pa.array(x) for x in cols[1:])], schema.names)

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(search, schema)
