"""Byte-level BPE in batched numpy merge rounds, and decoding."""

from __future__ import annotations

import functools
import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from busline.llm.common import append_from_text, slices

#: Pieces of text remembered by one Python worker with their ids, in each of two generations.
MEMO = 350_000
#: How byte-level vocabularies write bytes as printable characters, and how they split text.
_PLAIN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    rest = [b for b in range(256) if b not in _PLAIN]
    return {chr(b): b for b in _PLAIN} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(4)
def vocabulary(path: str) -> Bpe:
    """The vocabulary at path, read once by each Python worker."""
    return Bpe(path)


@functools.lru_cache(4)
def piece_encoder(path: str) -> PieceEncoder:
    """The encoder of the vocabulary at path, kept by a Python worker for all its tasks."""
    bpe = vocabulary(path)
    return PieceEncoder(bpe.encode_spaced, bpe.encode_each)


class Bpe:
    """A byte-level BPE vocabulary read from a tokenizers JSON file, applied in merge rounds over flat arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        self.special = {a["content"]: a["id"] for a in spec["added_tokens"] if a.get("special")}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        made = np.array([vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.key, self.rank, self.made = key[order], np.arange(len(key))[order], made[order]
        self.byte_id = np.full(256, -1, np.int64)
        for c, b in letters.items():
            self.byte_id[b] = vocab[c]
        pairs = self.byte_id[np.arange(65536) >> 8], self.byte_id[np.arange(65536) & 255]
        self.first_rank, self.first_made = self.ranks(*pairs)
        size = max([*vocab.values(), *self.special.values()]) + 1
        pieces: list[bytes] = [b""] * size
        for t, i in vocab.items():
            pieces[i] = bytes(letters[c] for c in t)
        for t, i in self.special.items():
            pieces[i] = t.encode()
        self.token_size = np.array([len(p) for p in pieces], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self.split = regex.compile(SPLIT)
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The text's words and special tokens, in order; joined they are the text."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        return [w for p in parts if p for w in ([p] if p in self.special else self.split.findall(p))]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (len(key) if unknown) and merged id of pairs, by binary search."""
        pair = (left << 32) | right
        at = np.searchsorted(self.key, pair)
        at[at == len(self.key)] = 0
        known = self.key[at] == pair
        return np.where(known, self.rank[at], len(self.key)), self.made[at]

    def merge(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in one array, and how many each word has.

        All symbols of all words stand in one array. A round takes each word's pair of lowest rank and merges all its
        places at once; ranks are looked up by binary search over the sorted pair keys, after the first round only for
        pairs that a merge has made. A word without a known pair leaves the array. Of overlapping places of a pair of
        equal symbols the leftmost counts, as when merging one by one.
        """
        none = len(self.key)
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        ids = np.flatnonzero(length)
        byte = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
        sym, length = self.byte_id[byte], length[ids]
        rank, made = np.full(len(sym), none), np.zeros(len(sym), np.int64)
        if len(sym):
            pair = byte[:-1] << 8 | byte[1:]
            rank[:-1], made[:-1] = self.first_rank[pair], self.first_made[pair]
            rank[np.cumsum(length) - 1] = none
        owners, symbols = [], []
        while len(ids):
            start = np.cumsum(length) - length
            best = np.minimum.reduceat(rank, start)
            go = best < none
            if not go.all():
                stay = np.repeat(go, length)
                owners.append(np.repeat(ids[~go], length[~go]))
                symbols.append(sym[~stay])
                sym, rank, made = sym[stay], rank[stay], made[stay]
                ids, length, best = ids[go], length[go], best[go]
                if not len(ids):
                    break
                start = np.cumsum(length) - length
            place = np.flatnonzero(rank == np.repeat(best, length))
            run = np.ones(len(place), bool)
            run[1:] = place[1:] != place[:-1] + 1
            first = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            place = place[(np.arange(len(place)) - first) % 2 == 0]
            sym[place] = made[place]
            keep = np.ones(len(sym), bool)
            keep[place + 1] = False
            gone = np.zeros(len(sym) + 1, np.int64)
            np.cumsum(~keep, out=gone[1:])
            bound = np.zeros((2, len(sym)), bool)
            bound[0, start], bound[1, start + length - 1] = True, True
            opens, ends = bound[0, place], bound[1, place + 1]
            length = length - (gone[start + length] - gone[start])
            place = place - gone[place]
            sym, rank, made = sym[keep], rank[keep], made[keep]
            rank[place[ends]] = none
            fresh = np.concatenate([place[~ends], place[~opens] - 1])
            rank[fresh], made[fresh] = self.ranks(sym[fresh], sym[fresh + 1])
        if not owners:
            return np.zeros(0, np.int64), np.zeros(len(raw), np.int64)
        owner = np.concatenate(owners)
        return np.concatenate(symbols)[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(raw))

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """merge() of words among which special tokens may stand."""
        special = [i for i, w in enumerate(words) if w in self.special] if self.special and not self.special.keys().isdisjoint(words) else []
        raw = [w.encode("utf-8", "replace") for w in words]
        for i in special:
            raw[i] = b""
        ids, count = self.merge(raw)
        if special:
            at = (np.cumsum(count) - count)[special]
            ids = np.insert(ids, at, [self.special[words[i]] for i in special])
            count[special] = 1
        return ids, count

    def encode_each(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; the words of all are merged together."""
        split = [self.words(t) for t in texts]
        ids, count = self.encode_words([w for ws in split for w in ws])
        data, upto = ids.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(count)])
        ends = upto[np.cumsum([0, *map(len, split)])] * 4
        return [data[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]

    def encode_spaced(self, names: list[str]) -> list[bytes]:
        """encode_each() of pieces, named without the space that each begins with, split in one go."""
        text = " " + " ".join(names)
        ids, _ = self.encode_words(self.words(text))
        return self.divided(ids, text, "<u4")

    def divided(self, ids: np.ndarray, text: str, kind: str) -> list[bytes]:
        """Cut the ids of a text, written as kind, where the bytes of their tokens reach its spaces and its end."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        ends = np.append(np.flatnonzero(raw == 0x20)[1:], len(raw))
        cut = np.concatenate([[0], np.searchsorted(np.cumsum(self.token_size[ids]), ends) + 1]) * np.dtype(kind).itemsize
        data = ids.astype(kind).tobytes()
        return [data[a:b] for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]

    def decode(self, ids: bytes) -> str:
        """The text of little-endian unsigned 32-bit ids; bytes that are no UTF-8 become replacement characters."""
        tok = np.frombuffer(ids, "<u4").astype(np.int64)
        size = self.token_size[tok]
        at = np.cumsum(size) - size
        take = np.arange(int(size.sum())) + np.repeat(self.token_start[tok] - at, size)
        return self.token_bytes[take].tobytes().decode("utf-8", "replace")


class PieceEncoder:
    """Encodes texts piece by piece, remembering the ids of pieces.

    A piece begins with each space that a character other than white space follows. Byte-level splitting never joins text
    across such a place, so pieces can be encoded apart; a text with white space after a space is encoded whole. The
    pieces of a slice are numbered by Arrow, so that Python sees each distinct one once, and the ids of all its texts are
    one `take` of those numbers.
    """

    def __init__(self, spaced: Callable[[list[str]], list[bytes]], each: Callable[[list[str]], list[bytes]]):
        self.spaced, self.each = spaced, each
        # No piece has no ids, so b"" stands for those that begin with white space.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the pieces' memory back: a worker that waits for its next task should hold the vocabulary alone."""
        self.known, self.older = {}, {}
        pa.default_memory_pool().release_unused()

    def pieces(self, names: list[str]) -> list[bytes]:
        """The ids of distinct pieces, given without their space; b"" for those that begin with white space."""
        ids = [*map(self.known.get, names)]
        lost = [i for i, x in enumerate(ids) if x is None]
        if len(self.known) + len(lost) > MEMO:  # what is in use stays, the rest becomes the older half
            self.older, self.known = self.known, {p: x for p, x in zip(names, ids) if x is not None}
        asked = [*map(names.__getitem__, lost)]
        old = [*map(self.older.get, asked)]
        found = {p: x for p, x in zip(asked, old) if x is not None}
        new = [p for p, x in zip(asked, old) if x is None]
        blank = {p: b"" for p in new if not p or p[0].isspace()}
        if blank:
            found.update(blank)
            new = [p for p in new if p not in blank]
        if new:
            found.update(zip(new, self.spaced(new)))
        self.known.update(found)
        for i, p in zip(lost, asked):
            ids[i] = found[p]
        return ids

    def __call__(self, texts: list) -> list[bytes]:
        out: list[bytes] = []
        for a, b in slices(texts, 3 << 19):
            split = pc.split_pattern(pa.array([t or "" for t in texts[a:b]], pa.string()), " ")
            first, flat = split.offsets.to_numpy(), split.values
            head = np.zeros(len(flat), bool)
            head[first[:-1]] = True
            coded = flat.filter(pa.array(~head)).dictionary_encode()
            ids = self.pieces(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
            number = np.empty(len(flat), np.int64)
            number[~head] = coded.indices.to_numpy()
            odd = np.append(np.fromiter(map(len, ids), np.int64, len(ids)) == 0, False)
            number[head] = len(ids)
            whole = np.logical_or.reduceat(odd[number], first[:-1])
            number[np.repeat(whole, np.diff(first))] = len(ids)
            number[head] = len(ids) + 1 + np.arange(b - a)
            heads = flat.filter(pa.array(head)).to_pylist()
            heads = self.each([texts[a + i] if w else h for i, (h, w) in enumerate(zip(heads, whole.tolist()))])
            taken = pa.array([*ids, b"", *heads], pa.large_binary()).take(pa.array(number))
            ends, data = np.frombuffer(taken.buffers()[1], np.int64)[first].tolist(), memoryview(taken.buffers()[2] or b"")
            out += [data[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:])]
        return out


FIELDS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def encode_documents(docs: DataFrame, path: str, with_ids: bool = False, digests: bool = True) -> DataFrame:
    """docs with n_tokens, and as asked ids (array<int>) and the SHA-256 of the ids and of the text decoded from them.

    path is the vocabulary file on every executor. Null and empty texts have no token; texts are encoded whole, however
    long. The special token's text is encoded as that token. Extra columns pass, except those named like a result;
    repeated rows are encoded one by one, an empty table gives no rows. No shuffle.
    """
    fields = T.StructType([*(FIELDS.fields if digests else FIELDS.fields[:1]), *([T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else [])])

    def start():
        bpe, encoder = vocabulary(path), piece_encoder(path)

        def run(texts: list) -> list[list]:
            ids = encoder(texts)
            out: list[list] = [[len(x) // 4 for x in ids]]
            if digests:
                out += [[hashlib.sha256(x).hexdigest() for x in ids], [hashlib.sha256(bpe.decode(x).encode("utf-8", "surrogatepass")).hexdigest() for x in ids]]
            return [*out, [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]] if with_ids else out

        return run

    return append_from_text(docs, start, fields)
