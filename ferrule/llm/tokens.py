"""Token counts at every prefix, and ids, of whole texts.

``prefix_counts`` stores, for each document, the library's exact token count of every prefix, code point by code point.
It is a dynamic programme: no token goes on over white space, so a text is split into units at its spaces and line feeds,
and the count of a prefix is that of the prefix before its last unit, and what the begin of this unit has by itself.
Each distinct unit is worked out once, part by part of the tokenizer's pattern, and its counts are remembered and
gathered for all of its places; splitting, finding distinct units and gathering are done in Arrow and NumPy for a batch
of texts. The begins of a part are counted by the library; in parts of more than ``LONG`` code points by the last token:
of all tokens that could end a prefix just one goes with the last token of what it leaves, and the count is that one's
and 1 (``Merges.prefixes``), so a part of n code points costs n steps. Questions of truncation and budget are then
lookups in these arrays; nothing is encoded again.

``pieces`` needs ids only. A byte-level vocabulary whose merges are in the order of its ids, and whose every token comes
out whole when its own string is merged, gives equal ids when adjacent tokens are merged by the rank of what they make:
a merge that the vocabulary lacks could only arise inside a token's own string, where it doesn't. Both conditions are
checked for the vocabulary file, and such a file is handed to the faster of the two public implementations; any other
goes through the library itself. Tests compare both on all code points.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.common import by_bytes

#: Fixed value: the byte-level tokenizer's pattern.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_LETTERS = [chr(c) for c in (*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x180)) if unicodedata.category(chr(c)) in ("Ll", "Lu") and len(chr(c).lower()) == 1]
_MARKS = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum()] + list("¡§«»¿–—‘’“”„•…€")
_L = "".join(map(re.escape, _LETTERS))
#: Units of these characters only are parted here; the library parts all others.
PLAIN = re.compile(f"[{_L}0-9{''.join(map(re.escape, _MARKS))}]*")
#: Fixed value: the pattern of the tokenizer with word ends, over the characters of PLAIN.
WORD_PARTS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^{_L}0-9]+")
#: Units that a worker remembers, and parts of them; beyond that it forgets those that didn't come up lately.
REMEMBERED = 400_000
#: Code points of a part up to which each of its begins is encoded by itself.
LONG = 48


def library_of(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_padding()
    library.no_truncation()
    return library


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Memory:
    """An array of numbers for each of some strings, all of them in one buffer."""

    def __init__(self, dtype):
        self.place: dict[str, int] = {}
        self.first, self.size, self.data = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 16, dtype)
        self.used = 0

    def add(self, strings: list[str], sizes: np.ndarray, values: np.ndarray) -> None:
        n = len(self.place)
        while n + len(strings) > len(self.first):
            self.first, self.size = np.concatenate([self.first, self.first]), np.concatenate([self.size, self.size])
        while self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data, self.data])
        self.data[self.used : self.used + len(values)] = values
        self.size[n : n + len(strings)] = sizes
        self.first[n : n + len(strings)] = self.used + np.cumsum(sizes) - sizes
        self.used += len(values)
        self.place.update(zip(strings, range(n, n + len(strings)), strict=True))

    def forget(self) -> None:
        self.place, self.used = {}, 0


def renewed(young: dict, old: dict) -> tuple[dict, dict]:
    """A memory of two halves: a full younger one becomes the older one, whose entries go with the next change unless they
    have come up again."""
    return ({}, young) if len(young) > REMEMBERED else (young, old)


def byte_symbols() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else the next
    one from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class Ids:
    """Ids by a byte-level tokenizer, special tokens' strings included."""

    def __init__(self, path: str):
        self.library = library_of(path)
        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        vocabulary, added = whole["model"]["vocab"], {t["content"]: t["id"] for t in whole["added_tokens"]}
        own = {t: i for t, i in vocabulary.items() if t not in added}
        self.encoding = None
        shape = whole["normalizer"] is None and whole["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": whole["pre_tokenizer"].get("trim_offsets"), "use_regex": True}
        if shape and self.by_rank(whole["model"]["merges"], own) and all(not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in whole["added_tokens"]):
            import tiktoken

            byte = {c: b for b, c in byte_symbols().items()}
            self.encoding = tiktoken.Encoding(path, pat_str=BYTE_LEVEL, mergeable_ranks={bytes(byte[c] for c in t): i for t, i in own.items()}, special_tokens=added)
        self.added = list(added)

    def by_rank(self, merges: list, own: dict[str, int]) -> bool:
        """Whether merging by the rank of what two tokens make is merging by this vocabulary."""
        made = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        tokenize = self.library.model.tokenize
        return sorted(own.values()) == list(range(len(own))) and [own.get(t) for t in made] == list(range(256, len(own))) and all([x.id for x in tokenize(t)] == [i] for t, i in own.items())

    def of(self, text: str) -> list[int]:
        if self.encoding is None:
            return self.library.encode(text, add_special_tokens=False).ids
        if any(t in text for t in self.added):
            return self.encoding.encode(text, allowed_special="all")
        return self.encoding.encode_ordinary(text)


class Merges:
    """Byte-pair merging of a part's symbols by the ranks of a vocabulary file, and the programme over its prefixes."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.end = model["end_of_word_suffix"]
        self.rank = {tuple(m if isinstance(m, list) else m.split(" ")): k for k, m in enumerate(model["merges"])}
        self.tokens = set(model["vocab"])
        self.longest = max(len(t.removesuffix(self.end)) for t in self.tokens)
        self.symbol = byte_symbols()
        self.agree: dict[tuple[str, str], bool] = {}

    def merged(self, symbols: list[str]) -> list[str]:
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 40))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out, i = [*out, pair[0] + pair[1]], i + 2
                else:
                    out, i = [*out, symbols[i]], i + 1
            symbols = out
        return symbols

    def symbols_of(self, token: str) -> list[str]:
        bare = token.removesuffix(self.end)
        return [*bare[:-1], bare[-1] + token[len(bare) :]]

    def together(self, before: str, token: str) -> bool:
        """Whether merging leaves the two tokens as they are, beside each other; ``before`` may be empty."""
        if (before, token) not in self.agree:
            if len(self.agree) > REMEMBERED:
                self.agree.clear()
            self.agree[before, token] = self.merged([*before, *self.symbols_of(token)]) == ([before, token] if before else [token])
        return self.agree[before, token]

    def prefixes(self, part: str) -> list[int]:
        """The token count of each prefix of a part, as a word of its own."""
        text, last, count, out = "", [""], [0], []
        for c in part:
            for b in c.encode("utf-8"):
                text += self.symbol[b]
                j, _ = self.ending(text, last, "")
                last.append(text[j:])
                count.append(count[j] + 1)
            out.append(count[self.ending(text, last, self.end)[0]] + 1)
        return out

    def ending(self, text: str, last: list[str], suffix: str) -> tuple[int, str]:
        """Where the last token of ``text`` begins, from the last tokens of its prefixes."""
        n = len(text)
        for j in range(n - 1, max(-1, n - 1 - self.longest), -1):
            token = text[j:] + suffix
            if token in self.tokens and self.together(last[j], token):
                return j, token
        raise AssertionError("no token ends a prefix")


class Counts:
    """Counts at every prefix of units by the tokenizer with word ends; those of a unit are followed by its whole count
    once more, for the white space after it."""

    def __init__(self, path: str):
        self.path, self.library, self.memory = path, library_of(path), Memory(np.int32)
        self.tokenize, self.symbols = self.library.model.tokenize, byte_symbols()
        self.parts: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.begins: dict[str, int] = {}
        self.merges: Merges | None = None
        added = self.library.get_added_tokens_decoder().values()
        self.special = re.compile("|".join(re.escape(t.content) for t in added) or r"(?!)")

    def count(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def part(self, part: str) -> list[int]:
        """The counts of the begins of a part that the tokenizer's pattern leaves whole."""
        if len(part) > LONG:
            self.merges = self.merges or Merges(self.path)
            return self.merges.prefixes(part)
        if part[0] == "'" and part[1:].isalpha():  # the begin of a contraction may be two parts
            return self.count([part[: k + 1] for k in range(len(part))])
        out, begins, known = [], self.begins, self.begins.get
        for k in range(1, len(part) + 1):
            begin = part[:k]
            n = known(begin)
            if n is None:
                n = begins[begin] = len(self.tokenize(begin if begin.isascii() else begin.encode("utf-8").decode("latin-1").translate(self.symbols)))
            out.append(n)
        return out

    def learn(self, new: list[str]) -> None:
        if len(self.begins) > 2 * REMEMBERED:
            self.begins.clear()
        self.parts, self.older = renewed(self.parts, self.older)
        values: list[int] = []
        parts, get, older, plain, special = self.parts, self.parts.get, self.older.get, PLAIN.fullmatch, self.special.search
        for u in new:
            if plain(u) and not special(u):
                before = 0
                for part in WORD_PARTS.findall(u.lower()):
                    own = get(part)
                    if own is None:
                        own = parts[part] = older(part) or self.part(part)
                    values += own if not before else [before + n for n in own]
                    before += own[-1]
                values.append(before)
            else:
                values += self.hard_unit(u)
        self.memory.add(new, np.array(list(map(len, new)), np.int64) + 1, np.array(values, np.int32))

    def known(self, split: pa.DictionaryArray) -> np.ndarray:
        """For each unit its place in the memory, in which all of them are from then on."""
        distinct = split.dictionary.to_pylist()
        if len(self.memory.place) > REMEMBERED:
            self.memory.forget()
        place = self.memory.place
        if new := [u for u in distinct if u not in place]:
            self.learn(new)
        return np.fromiter(map(place.__getitem__, distinct), np.int64, len(distinct))[split.indices.to_numpy()]

    def hard_unit(self, unit: str) -> list[int]:
        """The counts of a unit that the library must part: begin after begin of each part. A special token's string ends
        what is before it, and where it is not whole it is text."""
        out: list[int] = []
        at = before = 0
        for m in [*self.special.finditer(unit), None]:
            own = unit[at : m.start() if m else len(unit)]
            out += [before + n for n in self.hard_parts(own)]
            if m:
                cut = [own + m[0][:k] for k in range(1, len(m[0]))]
                out += [before + n for n in self.count(cut)]
                before += self.count([own + m[0]])[0]
                out.append(before)
                at = m.end()
        return [*out, out[-1] if out else 0]

    def hard_parts(self, text: str) -> list[int]:
        """The counts of a text without special tokens, part by part as the library parts it. Parts are counted together
        that share a code point, as one whose small form is two, or where what begins the later one may join with what is
        before it when the text is normalized."""
        if not text:
            return []
        e = self.library.encode(text, add_special_tokens=False)
        plain = unicodedata.is_normalized("NFC", text) and all(len(c.lower()) == 1 for c in set(text))
        stretches: list[list[int]] = []  # begin, end, tokens
        word = None
        for w, (a, z) in zip(e.word_ids, e.offsets, strict=True):
            alone = plain or (unicodedata.category(text[a])[0] in "LNPS" and not "\u1100" <= text[a] <= "\u11ff")
            # what is a contraction in a prefix is none where a mark follows: "'s" and a mark are an apostrophe and a letter
            cut = not plain and text[a - 1 : a] == "'" and a > 0
            if stretches and (w == word or a < stretches[-1][1] or not alone or cut):
                stretches[-1][1:] = [max(stretches[-1][1], z), stretches[-1][2] + 1]
            else:
                stretches.append([a, z, 1])
            word = w
        out: list[int] = []
        counted = 0
        for a, z, n in stretches:
            out += [counted] * (a - len(out))
            own = self.part(text[a:z].lower()) if plain and z - a > LONG else self.count([text[a : j + 1] for j in range(a, z)])
            out += [counted + c for c in own]
            counted += n
        return out + [counted] * (len(text) - len(out))

    def prefixes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The counts at all prefixes of all texts, one after another, and how many each text has."""
        lists = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        which = self.known(lists.flatten().dictionary_encode())
        memory = self.memory
        sizes, first = memory.size[which], memory.first[which]
        upto = np.concatenate([[0], np.cumsum(memory.data[first + sizes - 1], dtype=np.int64)])
        units = pc.list_value_length(lists).to_numpy().astype(np.int64)
        text_first = np.cumsum(units) - units
        before = upto[:-1] - np.repeat(upto[text_first], units)
        values = memory.data[ragged(first, sizes)] + np.repeat(before, sizes)
        lengths = np.diff(np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([text_first, [len(which)]])])
        keep = np.ones(len(values), bool)  # no white space follows the last unit of a text
        keep[np.cumsum(lengths) - 1] = False
        return values[keep].astype(np.int32), lengths - 1


_known: dict[tuple, object] = {}


def own(path: str, kind: type):
    """A worker's own instance for a tokenizer file."""
    if (path, kind) not in _known:
        _known[path, kind] = kind(path)
    return _known[path, kind]


def prefix_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, and prefix_tokens: the token count of each prefix, for 1, 2, ... code points.

    A null text counts as an empty one, which has no tokens and an empty array. Repeated rows each give a row. ``path``
    names a file of the tokenizer with word ends. Only the id and text columns are read.
    """
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("prefix_tokens", T.ArrayType(T.IntegerType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = own(path, Counts)
        for batch in by_bytes(batches, 1):
            values, sizes = units.prefixes(batch.column(1))
            ends = np.cumsum(sizes)
            totals = np.where(sizes > 0, np.append(values, 0)[ends - 1], 0)
            arrays = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals.astype(np.int64)), batch.column(2), arrays], schema.names)

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.select("doc_id", "text", F.octet_length("text").cast("long").alias("n_bytes")).mapInArrow(count, schema)


def longest_prefix(budget: Column | int, tokens: str = "prefix_tokens") -> Column:
    """Where to cut a text so that it has at most ``budget`` tokens: the code points of its longest such prefix, else 0.
    (A longer prefix may have fewer tokens, as a word's end can make one token of several.)"""
    limit = F.lit(budget) if isinstance(budget, int) else budget
    return F.aggregate(F.transform(tokens, lambda n, i: F.when(n <= limit, i + 1).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))


def tokens_before(place: Column | int, tokens: str = "prefix_tokens") -> Column:
    """The tokens of the first ``place`` code points of a text; of all where it has no more."""
    at = F.lit(place) if isinstance(place, int) else place
    return F.when((at <= 0) | (F.size(tokens) == 0), F.lit(0)).otherwise(F.get(tokens, F.least(at, F.size(tokens)) - 1))


def pieces(texts: list[str], path: str, capacity: int, end_id: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """text, piece, start, length and ids_crc32 of each text's ids with ``end_id`` after them; of texts beyond
    ``capacity`` the first piece takes what the whole pieces leave."""
    ids_of = own(path, Ids).of
    for k, text in enumerate(texts):
        ids = ids_of(text)
        n = len(ids) + 1
        ids.append(end_id)
        view = memoryview(np.array(ids, "<u4")).cast("B")
        cuts = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
        for piece, (a, z) in enumerate(zip(cuts, cuts[1:], strict=False)):
            yield k, piece, a, z - a, crc32(view[4 * a : 4 * z])
