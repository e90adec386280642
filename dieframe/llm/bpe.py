"""BPE encoding and decoding by forced-boundary splitting.

Two adjacent bytes that stand together inside no vocabulary token can never be merged across, so every such
place is a certain cut. A piece of a word falls into fragments there; each is encoded on its own, and the ids
are concatenated. Texts are taken in slices, as arrays of bytes: each distinct word of a slice is cut into pieces once,
each distinct piece merged once, and the ids of words and texts are gathered from those.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession

from .common import released, sized, table

WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACES = [c.encode() for c in map(chr, range(0x3001)) if re.match(f"[{WHITE}]", c)]
SPACE = np.isin(np.arange(256), [c[0] for c in SPACES if len(c) == 1])  # by byte
LONG_SPACES = np.array([int.from_bytes(c[:2]) << 8 | c[-1] for c in SPACES if len(c) > 1])  # of two bytes: the last one twice
OTHER, LETTER, DIGIT = range(3)
#: By byte, in words of ASCII and of U+00C0 to U+00FF, which are letters but for two signs and begin with byte LATIN.
KIND = np.array([LETTER if b >= 0x80 or chr(b).isalpha() else DIGIT if chr(b).isdigit() else OTHER for b in range(256)], np.uint8)
LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
LATIN = 0xC3
TIMES, DIVIDED = 0x97, 0xB7  # their second bytes; TIMES stands where a small letter has DIVIDED
ODD = np.array([b == 0x27 or (b >= 0xC0 and b != LATIN) for b in range(256)])  # bytes of all other words, and of those with an apostrophe
#: Letters, digits and lower-case forms that Unicode 16 added to the tables of Python's unicodedata
#: (first and last code point; for lower case also that of the first one's lower-case form).
NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5),
    (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
NEW_DIGITS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
NEW_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3),
    (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
LOWER = {0x3A3: 0x3C3} | {first + i: low + i for first, last, low in NEW_LOWER for i in range(last - first + 1)}  # capital sigma: never final
UNUSUAL = re.compile("[" + "".join(map(chr, LOWER)) + "]")
END = "</w>"
NEVER = 1 << 60  # ranks of no merge
NO_RANK = (1 << 31) - 1  # the same in arrays
BITS = 32  # of an id in a pair
SLICE = 2 << 20  # bytes of text taken together
TOGETHER = 1 << 12  # fragments merged in one go
LONG = 48  #: letters of a word beyond which it is not kept, bytes of a fragment beyond which it is merged through a heap


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def character_class(kind: str) -> str:
    """The inside of a bracketed class of all characters of a general category (L or N), Unicode 16 included."""
    new = NEW_LETTERS if kind == "L" else NEW_DIGITS
    categories = "".join(map(unicodedata.category, map(chr, range(sys.maxunicode + 1))))  # two letters each
    of_kind = np.frombuffer(categories.encode(), np.uint8)[::2] == ord(kind)
    for first, last in new:
        of_kind[first : last + 1] = True
    edge = np.flatnonzero(np.diff(of_kind.astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    return "".join(f"\\U{a:08x}" if b - a == 1 else f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.tolist())


def parts(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values (binary or string, none null) one after the other, and where each begins and ends."""
    if not len(values):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    edge = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    return np.frombuffer(values.buffers()[2] or b"", np.uint8)[edge[0] : edge[-1]], edge - edge[0]


def values_of(byte: np.ndarray, edge: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(edge) - 1, [None, pa.py_buffer(edge.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(byte))])


def upto(many: np.ndarray) -> np.ndarray:
    """0 and the sums up to each."""
    return np.append(0, np.cumsum(many))


def expand(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For one after the other the numbers first, first + 1, ..., so many of them."""
    end = np.cumsum(many)
    return np.repeat(first - end + many, many) + np.arange(end[-1] if len(end) else 0)


class Recent(dict):
    """A cache of two generations: when it is full, the older one goes; what was used since then stays."""

    def __init__(self, make: Callable, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONG:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if 2 * len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value


class Vocabulary:
    """Of a tokenizer file: word-end byte-level BPE behind NFC, blank folding and lower case."""

    def __init__(self, text: str, cached: int = 40_000):
        file = json.loads(text)
        model, pre = file["model"], file["pre_tokenizer"]["pretokenizers"]
        kinds = [x["type"] for x in file["normalizer"]["normalizers"]]
        if kinds != ["NFC", "Replace", "Lowercase"] or model["end_of_word_suffix"] != END or file["decoder"] or model["dropout"]:
            raise ValueError("not a vocabulary of the supported kind")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {x["content"]: x["id"] for x in file["added_tokens"]}
        names = self.ids | self.special
        self.tokens = np.empty(max(names.values()) + 1, object)
        self.tokens[[*names.values()]] = [*names]
        pattern = pre[0]["pattern"]["Regex"]
        self.plain = re.compile(pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9").replace(r"\s", WHITE), re.ASCII)
        self.pattern = re.compile(pattern.replace(r"\p{L}", character_class("L")).replace(r"\p{N}", character_class("N")).replace(r"\s", WHITE))
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.letters = byte_letters()
        pairs = (x if isinstance(x, list) else x.split(" ") for x in model["merges"])
        pairs = [*pairs]
        self.merges = {self.ids[a] << BITS | self.ids[b]: rank for rank, (a, b) in enumerate(pairs)}
        self.made = [self.ids[a + b] for a, b in pairs]  # by rank
        bare = [t.removesuffix(END) for t in self.ids]
        self.inside = {pair for t in bare for pair in zip(t, t[1:])}
        self._tables()
        self.found = Recent(self._found, cached)

    def _tables(self) -> None:
        """The same by bytes, for many pieces at once. A byte that ends its piece counts 256 more."""
        byte = {x: b for b, x in enumerate(self.letters)}
        self.near = np.zeros((256, 256), bool)
        for a, b in self.inside:
            if a in byte and b in byte:
                self.near[byte[a], byte[b]] = True
        self.of_byte = np.array([self.ids[x] for x in self.letters] + [self.ids[x + END] for x in self.letters], np.int64)
        self.keys = np.array(sorted(self.merges), np.int64)
        self.ranks = np.array([self.merges[k] for k in self.keys.tolist()], np.int32)
        self.made_ids = np.array(self.made, np.int64)
        self.byte_ranks = self._lookup(self.of_byte[:256, None], self.of_byte[None, :])

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of ids; NO_RANK where they don't merge, or one is -1."""
        key = a << BITS | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], NO_RANK)

    def forget(self) -> None:
        """Empties the cache."""
        self.found.clear()
        self.found.old = {}

    def _long(self, s: list[int]) -> list[int]:
        """Merges by rank, leftmost first, in n log n steps: a heap of places, and links to the neighbours that are left."""
        get = self.merges.get
        after, before = [*range(1, len(s)), -1], [*range(-1, len(s) - 1)]
        heap = [(m, k, a, b) for k, (a, b) in enumerate(zip(s, s[1:])) if (m := get(a << BITS | b, NEVER)) < NEVER]
        heapq.heapify(heap)
        while heap:
            best, k, *pair = heapq.heappop(heap)
            n = after[k]
            if s[k] < 0 or n < 0 or [s[k], s[n]] != pair:
                continue
            s[k], s[n] = self.made[best], -1
            after[k] = after[n]
            if after[n] >= 0:
                before[after[n]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b >= 0 and (m := get(s[a] << BITS | s[b], NEVER)) < NEVER:
                    heapq.heappush(heap, (m, a, s[a], s[b]))
        return [x for x in s if x >= 0]

    def _found(self, raw: str) -> list[bytes]:
        """The pieces of any word."""
        if raw.isascii():
            return [x.encode() for x in self.plain.findall(raw.lower())]
        text = unicodedata.normalize("NFC", raw)
        return [x.encode() for x in self.pattern.findall((text.translate(LOWER) if UNUSUAL.search(text) else text).lower())]

    def _words(self, byte: np.ndarray, edge: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The words of texts that lie between edges: distinct ones, which of them each word is, and the texts' edges among words.

        Words are in lower case, but for those that ODD tells.
        """
        white = SPACE[byte]
        at = np.flatnonzero((byte == 0xC2) | ((byte >= 0xE1) & (byte <= 0xE3)))
        if len(at):
            at = np.column_stack([at, at + 1, at + np.where(byte[at] == 0xC2, 1, 2)])
            at = at[np.isin(byte[at].astype(np.int64) @ [1 << 16, 1 << 8, 1], LONG_SPACES)]
            white[at] = True
        inside = ~white
        new = inside.copy()
        new[1:] &= white[:-1]
        begin = edge[:-1][edge[:-1] < len(byte)]
        new[begin] = inside[begin]
        texts = np.searchsorted(np.flatnonzero(new), edge)
        first, byte = np.flatnonzero(new[inside]), byte[inside]
        if not len(first):
            return pa.array([], pa.binary()), first, texts
        words = np.append(first, len(byte))
        low = LOW[byte]
        at = np.flatnonzero(byte == LATIN) + 1
        low[at[(byte[at] < 0x9F) & (byte[at] != TIMES)]] += 32
        odd = np.logical_or.reduceat(ODD[byte], first)
        if odd.any():
            low = np.where(np.repeat(odd, np.diff(words)), byte, low)
        coded = values_of(low, words).dictionary_encode()
        return coded.dictionary, coded.indices.to_numpy(), texts

    def _pieces(self, words: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The pieces of words, and each word's first one and their number."""
        byte, edge = parts(words)
        odd = np.logical_or.reduceat(ODD[byte], edge[:-1])
        plain, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        found = [self.found[w] for w in words.take(rest).cast(pa.string()).to_pylist()]
        many = np.empty(len(words), np.int64)
        many[rest] = [*map(len, found)]
        pieces = pa.array(chain.from_iterable(found), pa.binary())
        if len(plain):
            byte, edge = parts(words.take(plain)) if len(rest) else (byte, edge)
            kind = KIND[byte]
            at = np.flatnonzero(byte == LATIN)
            at = at[(byte[at + 1] == TIMES) | (byte[at + 1] == DIVIDED)]
            kind[at] = kind[at + 1] = OTHER
            new = np.append(True, (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT))
            new[edge[:-1]] = True
            first = np.flatnonzero(new)
            many[plain] = np.diff(np.searchsorted(first, edge))
            pieces = pa.concat_arrays([values_of(byte, np.append(first, len(byte))), pieces])
        begin, order = np.empty(len(words), np.int64), np.append(plain, rest)
        begin[order] = upto(many[order])[:-1]
        return pieces, begin, many

    def _merged(self, byte: np.ndarray, edge: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each fragment has (edge: where they begin and end), and the ids. Merges go on in all fragments at once.

        Each step takes the best merge of every fragment, the leftmost of equal ones. Places are linked to those left.
        """
        size = np.diff(edge)
        many, ids = np.zeros(len(size), np.int64), np.empty(len(byte), np.int64)
        rest = np.argsort(size, kind="stable")
        for at in range(0, len(rest), TOGETHER):
            own = rest[at : at + TOGETHER]
            n = size[own]
            width = int(n.max())
            if width > LONG:
                for f in own[n > LONG].tolist():
                    one = self._long(self.of_byte[byte[edge[f] : edge[f + 1]]].tolist())
                    many[f] = len(one)
                    ids[edge[f] : edge[f] + len(one)] = one
                own = own[n <= LONG]
                if not len(own):
                    continue
                n = size[own]
                width = int(n.max())
            place = np.arange(width + 1)
            there = place < n[:, None]  # the last column is no place
            b = byte[np.where(there, edge[own][:, None] + place, 0)]
            s = np.where(there, self.of_byte[b], -1)
            rank = np.full(s.shape, NO_RANK, np.int32)
            rank[:, :-1] = np.where(there[:, 1:], self.byte_ranks[b[:, :-1] & 255, b[:, 1:]], NO_RANK)
            after = np.where(place + 1 < n[:, None], place + 1, width)
            before = np.broadcast_to(np.where(place > 0, place - 1, width), s.shape).copy()
            row = np.arange(len(own))
            while len(row):
                k = rank[row].argmin(1)
                best = rank[row, k]
                on = best < NO_RANK
                row, k, new = row[on], k[on], self.made_ids[best[on]]
                gone, low = after[row, k], before[row, k]
                high = after[row, gone]
                s[row, k], s[row, gone], rank[row, gone] = new, -1, NO_RANK
                after[row, k], before[row, high] = high, k
                rank[row, k] = self._lookup(new, s[row, high])
                rank[row, low] = self._lookup(s[row, low], new)
            left = s >= 0
            many[own] = left.sum(1)
            ids[expand(edge[own], many[own])] = s[left]
        return many, ids[expand(edge[:-1], many)]

    def _encode_pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after the other, and the pieces' edges among them."""
        byte, end = parts(pieces)
        byte = byte.astype(np.int64)
        cut = np.append(True, ~self.near[byte[:-1], byte[1:]])
        cut[end[:-1]] = True
        byte[end[1:] - 1] += 256
        edge = np.append(np.flatnonzero(cut), len(byte))
        many, ids = self._merged(byte, edge)
        return ids.astype("<u4"), upto(many)[np.searchsorted(edge, end)]

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """`encode_column` of texts without special tokens."""
        words, which, edge = self._words(*parts(texts))
        if not len(which):
            return np.empty(0, "<u4"), np.zeros(len(edge), np.int64)
        pieces, first, many = self._pieces(words)
        coded = pieces.dictionary_encode()
        ids, at = self._encode_pieces(coded.dictionary)
        piece = coded.indices.to_numpy()[expand(first, many)]
        size = np.diff(at)[piece]
        of_word = ids[expand(at[piece], size)]
        at = upto(size)[upto(many)]
        size = np.diff(at)[which]
        return of_word[expand(at[which], size)], upto(size)[edge]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts one after the other, as little-endian unsigned 32-bit integers, and the texts' edges among them."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        texts.validate(full=True)
        if not any(pc.any(pc.match_substring(texts, x)).as_py() for x in self.special):
            return self._encode(texts)
        cut = [self.specials.split(t) for t in texts.to_pylist()]
        flat = [*chain.from_iterable(cut)]
        ids, edge = self._encode(pa.array(["" if x in self.special else x for x in flat], pa.string()))
        own = np.array([self.special.get(x, -1) for x in flat], np.int64)
        ids = np.insert(ids, edge[:-1][own >= 0], own[own >= 0].astype("<u4"))
        return ids, (edge + upto(own >= 0))[upto([*map(len, cut)])]

    def encode_all(self, texts: pa.Array | list[str | None]) -> list[bytes]:
        """The ids of each text; null and empty text: none."""
        ids, edge = self.encode_column(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        ids, edge = ids.tobytes(), (4 * edge).tolist()
        return [ids[a:b] for a, b in zip(edge[:-1], edge[1:])]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes | None) -> str:
        return " ".join(self.tokens[np.frombuffer(ids or b"", "<u4")].tolist())


def shared_vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The tokenizer file (one, of fixed size) for `vocabulary` in tasks."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast({"file": f.read()})


def vocabulary(shared: Broadcast) -> Vocabulary:
    """Built once a worker process, which serves many tasks: it is kept beside the broadcast file, of which a process has one copy."""
    kept = shared.value
    if "made" not in kept:
        kept["made"] = Vocabulary(kept.pop("file"))
    return kept["made"]


def _add(docs: DataFrame, path: str, source: str, made: dict[str, tuple[pa.DataType, str]], use: Callable) -> DataFrame:
    """docs with more columns: the rows that `use` makes of a vocabulary and a batch's values of `source`. The vocabulary (one file) is broadcast."""
    clash = set(map(str.lower, made)) & set(map(str.lower, docs.columns))
    if clash:
        raise ValueError(f"columns that exist already: {sorted(clash)}")
    shared = shared_vocabulary(docs.sparkSession, path)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(shared)
        for part in sized(batches, names.index(source), 2048, SLICE):
            rows = use(words, part.column(names.index(source)))
            new = [pa.array([r[i] for r in rows], kind) for i, (kind, _) in enumerate(made.values())]
            yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *made])
        words.forget()  # a worker process goes on to other work

    fields = reduce(lambda s, f: s.add(f), docs.schema.fields, type(docs.schema)())
    return docs.mapInArrow(released(run), reduce(lambda s, c: s.add(c, made[c][1]), made, fields))


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds out_col: the ids as little-endian unsigned 32-bit integers. Null and empty text: no ids.

    Special tokens that stand in a text become their ids; none are added. Any other columns are kept; a frame
    that has out_col already is an error.
    """
    return _add(docs, path, text_col, {out_col: (pa.binary(), "binary")}, lambda v, xs: [(x,) for x in v.encode_all(xs)])


def decode(docs: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds out_col: the tokens joined by a blank, special ones included (the file names no decoder). No ids: ''."""
    return _add(docs, path, ids_col, {out_col: (pa.string(), "string")}, lambda v, xs: [(v.decode(x),) for x in xs.to_pylist()])


def round_trip(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """Encodes, decodes the ids, and adds n_tokens, ids_sha256 and decoded_sha256 in one pass.

    Nulls, special tokens and other columns are treated as `encode` and `decode` do; ids and texts stay in the task.
    """

    def both(v: Vocabulary, texts: pa.Array) -> list[tuple]:
        return [(len(x) // 4, hashlib.sha256(x).hexdigest(), hashlib.sha256(v.decode(x).encode("utf-8")).hexdigest()) for x in v.encode_all(texts)]

    return _add(docs, path, text_col, {"n_tokens": (pa.int64(), "long"), "ids_sha256": (pa.string(), "string"), "decoded_sha256": (pa.string(), "string")}, both)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; null text counts as empty."""
    return round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), default_path()).drop("text")
