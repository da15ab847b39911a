"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Every leaf of the tree holds the key ``rank * leaves + position`` of the pair that starts at that symbol, so the
root is the leftmost lowest-rank merge. A merge changes three leaves (the pair itself, its left and its right
neighbour), each a logarithmic point update; encoding ends when no leaf holds a rank. Pieces of a batch that are
short share one matrix of trees (:func:`_encode_short`), long ones get a tree of their own (:func:`encode_long`),
so one piece of n symbols costs O(n log n) whatever its length.

Cases: a null text has null ids (the registered query reads null as empty); an empty text has no ids; special
tokens spelled out in a text become their ids, as the library does by default; repeated rows are encoded alike;
an empty table gives an empty table; columns other than the named ones pass through, and an existing output
column of that name is replaced.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the pre-tokenizer's pattern. Its white space is Unicode's.
PIECE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Entries that a worker remembers before it starts over.
CACHE = 300_000
#: Symbols up to which pieces share a matrix of trees.
SHORT = 32
#: Characters of texts handled at once.
SLICE = 1_000_000
NONE = np.iinfo(np.int64).max


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write for the 256 bytes: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """A vocabulary with ranked merges, read from the JSON text of a tokenizer file."""

    def __init__(self, spec: str, cache: int = CACHE):
        j, alphabet = json.loads(spec), byte_alphabet()
        vocab = j["model"]["vocab"]
        self.byte_id = np.zeros(256, np.int32)
        for ch, b in alphabet.items():
            self.byte_id[b] = vocab[ch]
        self.special = {t["content"]: t["id"] for t in j.get("added_tokens", ())}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.piece_of: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.piece_of[i] = bytes(alphabet[c] for c in t)
        for t, i in self.special.items():
            self.piece_of[i] = t.encode()
        self.length = np.fromiter(map(len, self.piece_of), np.int64, size)
        self.start = np.cumsum(self.length) - self.length
        self.letters = np.frombuffer(b"".join(self.piece_of), np.uint8)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in j["model"]["merges"]]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.rank_of = {int(k): r for r, k in enumerate(keys)}
        self.pattern = regex.compile(PIECE)
        self.gap = regex.compile(r"\s\s|^\s|\s$")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.cache = cache

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of symbol pairs, -1 for none."""
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], -1)

    def _encode_short(self, raw: list[bytes]) -> list[bytes]:
        """Encode pieces of at most SHORT bytes together: row i of the matrix is the segment tree of piece i."""
        n = np.fromiter(map(len, raw), np.int64, len(raw))
        width = 1 << max(1, int(n.max() - 1).bit_length())
        sym = np.full((len(raw), width + 1), -1, np.int32)
        sym[:, :width][np.arange(width) < n[:, None]] = self.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        tree = np.full((len(raw), 2 * width), NONE, np.int64)
        rank = self.pair_ranks(sym[:, :-1], sym[:, 1:])
        tree[:, width:] = np.where(rank >= 0, rank * width + np.arange(width), NONE)
        for node in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1], out=tree[:, node])
        after = np.tile(np.arange(1, width + 2, dtype=np.int32), (len(raw), 1))
        before = np.tile(np.arange(-1, width, dtype=np.int32), (len(raw), 1))
        after[:, width] = width
        row = np.flatnonzero(tree[:, 1] != NONE)
        while len(row):
            root = tree[row, 1]
            i = root % width
            k = after[row, i]
            sym[row, i], sym[row, k] = self.made[root // width], -1
            nk, p = after[row, k], before[row, i]
            after[row, i], before[row, nk] = nk, i
            for leaf, a, b in ((k, None, None), (i, sym[row, i], sym[row, nk]), (p, sym[row, p], sym[row, i])):
                key = NONE if a is None else np.where((r := self.pair_ranks(a, b)) >= 0, r * width + leaf, NONE)
                there = (leaf >= 0) & (leaf < width)
                rows, node = row[there], width + leaf[there]
                tree[rows, node] = key if a is None else key[there]
                while len(node) and node[0] > 1:
                    node = node // 2
                    tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])
            row = row[tree[row, 1] != NONE]
        left = sym >= 0
        ends, flat = np.cumsum(left.sum(1)) * 4, sym[left].tobytes()
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_long(self, raw: bytes) -> bytes:
        """Encode one piece of any length with its own segment tree; returns int32 ids as bytes."""
        sym = self.byte_id[np.frombuffer(raw, np.uint8)].tolist()
        n, width = len(sym), 1 << max(1, (len(sym) - 1).bit_length())
        rank_of, made, none = self.rank_of, self.made, int(NONE)
        tree = [none] * (2 * width)
        for i in range(n - 1):
            r = rank_of.get(sym[i] << 20 | sym[i + 1])
            if r is not None:
                tree[width + i] = r * width + i
        for node in range(width - 1, 0, -1):
            tree[node] = min(tree[2 * node], tree[2 * node + 1])
        after, before = [*range(1, n + 1)], [*range(-1, n - 1)]

        def update(leaf: int, key: int) -> None:
            node = width + leaf
            tree[node] = key
            while node > 1:
                node >>= 1
                tree[node] = min(tree[2 * node], tree[2 * node + 1])

        def key(a: int, b: int) -> int:
            r = rank_of.get(sym[a] << 20 | sym[b])
            return none if r is None else r * width + a

        while tree[1] != none:
            r, i = divmod(tree[1], width)
            k = after[i]
            sym[i], sym[k], after[i] = int(made[r]), -1, after[k]
            update(k, none)
            if after[i] < n:
                before[after[i]] = i
                update(i, key(i, after[i]))
            else:
                update(i, none)
            if before[i] >= 0:
                update(before[i], key(before[i], i))
        return np.array([s for s in sym if s >= 0], np.int32).tobytes()

    def _pieces(self, chunk: str) -> list[str]:
        """Pieces of a text without special tokens. A single space between two other characters always starts a piece, so most texts split there and the pattern runs on chunks not seen before."""
        if not chunk:
            return []
        if self.gap.search(chunk):
            return self.pattern.findall(chunk)
        head, *rest = chunk.split(" ")
        return [head, *[" " + x for x in rest]]

    def _learn(self, new: list[str]) -> None:
        """Encode chunks not seen before and remember them."""
        if len(self.known) + len(new) > self.cache:
            self.known.clear()
        parts = [(c.encode(),) if c.isalpha() or c[:1] == " " and c[1:].isalpha() else [x.encode() for x in self.pattern.findall(c)] for c in new]
        words = list({w for p in parts for w in p})
        done: dict[bytes, bytes] = {}
        words.sort(key=len)
        for lo in range(0, len(words), 20_000):
            short = [w for w in words[lo : lo + 20_000] if len(w) <= SHORT]
            if short:
                done.update(zip(short, self._encode_short(short), strict=True))
        done.update((w, self.encode_long(w)) for w in words if len(w) > SHORT)
        self.known.update((c, done[p[0]] if len(p) == 1 else b"".join([done[x] for x in p])) for c, p in zip(new, parts, strict=True))

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian int32 bytes."""
        runs = [[] if not t else [t] if not (self.split and self.split.search(t)) else self.split.split(t) for t in texts]
        special = self.special
        cut = [[p for r in run for p in ([r] if r in special else self._pieces(r))] for run in runs]
        new = set().union(*cut) - self.known.keys() - special.keys()
        if len(self.known) + len(new) > self.cache:
            new = set().union(*cut) - special.keys()
        if new:
            self._learn(list(new))
        if special and any(len(r) > 1 or r and r[0] in special for r in runs):
            known = self.known | {t: np.int32(i).tobytes() for t, i in special.items()}
        else:
            known = self.known
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def decode_batch(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of runs of ids, given end to end with the length of each run. Bytes that are not UTF-8 become U+FFFD; ids out of the vocabulary are left out."""
        ids = ids.astype(np.int64)
        known = (ids >= 0) & (ids < len(self.length))
        ids = np.where(known, ids, 0)
        size = np.where(known, self.length[ids], 0)
        ends = np.cumsum(size)
        at = np.repeat(self.start[ids] - ends + size, size)
        at += np.arange(len(at))
        raw = self.letters[at].tobytes()
        cuts = np.concatenate(([0], ends))[np.cumsum(np.concatenate(([0], counts)))].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids) -> str:
        return self.decode_batch(np.asarray(ids, np.int64), np.array([len(ids)], np.int64))[0]


_MADE: dict[int, ByteBPE] = {}


def tokenizer(spec: str) -> ByteBPE:
    """One tokenizer, with its cache, for each worker process and vocabulary."""
    key = hash(spec)
    if key not in _MADE:
        _MADE[key] = ByteBPE(spec)
    return _MADE[key]


def read_spec(path: str) -> str:
    """The tokenizer file, read once on the driver; it reaches executors with the function."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def slices(texts: list[str | None]) -> Iterator[list[str | None]]:
    """Runs of texts of bounded size, so that a batch of very long ones does not pile up."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t or "")
        if size > SLICE:
            yield part
            part, size = [], 0
    if part:
        yield part


def _ids_array(parts: list[bytes], valid: list[bool]) -> pa.Array:
    ends = np.cumsum([0] + [len(p) // 4 for p in parts])
    flat = pa.array(np.frombuffer(b"".join(parts), np.int32), pa.int32())
    offsets = pa.array(ends.astype(np.int32), pa.int32(), mask=np.array([not v for v in valid] + [False]))
    return pa.ListArray.from_arrays(offsets, flat)


def encode(text: Column | str, spec: str) -> Column:
    """``array<int>`` of token ids of a text column; null for null."""

    @F.arrow_udf("array<int>")
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(spec)
        for batch in batches:
            texts = batch.to_pylist()
            parts = [ids for part in slices(texts) for ids in bpe.encode_batch(part)]
            yield _ids_array(parts, [t is not None for t in texts])

    return bpe_encode(text)


def count(text: Column | str, spec: str) -> Column:
    """``bigint`` number of tokens of a text column; 0 for null."""

    @F.arrow_udf("bigint")
    def bpe_count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(spec)
        for batch in batches:
            yield pa.array([len(ids) // 4 for part in slices(batch.to_pylist()) for ids in bpe.encode_batch(part)], pa.int64())

    return bpe_count(text)


def decode(ids: Column | str, spec: str) -> Column:
    """Text of an ``array<int>`` column; null for null."""

    @F.arrow_udf("string")
    def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(spec)
        for batch in batches:
            flat = batch.flatten().to_numpy(zero_copy_only=False)
            sizes = np.array([n or 0 for n in batch.value_lengths().to_pylist()], np.int64)
            ends, texts, lo = np.cumsum(sizes), [], 0
            while lo < len(sizes):  # runs of about a million ids
                at = ends[lo] - sizes[lo]
                hi = max(lo + 1, int(np.searchsorted(ends, at + SLICE // 4, "right")))
                texts += bpe.decode_batch(flat[at : ends[hi - 1]], sizes[lo:hi])
                lo = hi
            yield pa.array(texts, pa.string(), mask=np.array(batch.is_null().to_pylist(), bool))

    return bpe_decode(ids)


def round_trip(text: Column | str, spec: str) -> Column:
    """``struct<ids, decoded>``: the ids of a text column and the text that these ids decode to, by one Python worker for both; nulls for null."""

    @F.arrow_udf("struct<ids:array<int>,decoded:string>")
    def bpe_round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = tokenizer(spec)
        for batch in batches:
            texts = batch.to_pylist()
            ids, decoded = [], []
            for part in slices(texts):
                here = bpe.encode_batch(part)
                ids += here
                decoded += bpe.decode_batch(np.frombuffer(b"".join(here), np.int32), np.array([len(x) // 4 for x in here], np.int64))
            null = np.array([t is None for t in texts], bool)
            yield pa.StructArray.from_arrays([_ids_array(ids, (~null).tolist()), pa.array(decoded, pa.string(), mask=null)], names=["ids", "decoded"])

    return bpe_round_trip(text)


def encode_decode(docs: DataFrame, spec: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of a text column and the text that these ids decode to."""
    out = docs.withColumn("__bpe", round_trip(F.col(text), spec))
    return out.withColumns({ids: F.col("__bpe.ids"), decoded: F.col("__bpe.decoded")}).drop("__bpe")
