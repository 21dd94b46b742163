"""Byte-level BPE as a streaming transducer, and its inverse.

Text runs through two machines that hold a bounded window each:

* The piece splitter cuts text at the pre-tokenisation pattern. A piece is stable as soon as the character after
  it has been seen, so text is read in chunks and only an unfinished tail is carried on.
* The merger turns a piece's bytes into tokens. Merges never cross a piece, so a piece that fits the window is
  encoded whole. A longer one is fed byte by byte: after ``lookahead`` further bytes nothing to the right can
  change a token any more (see ``Merges.lookahead``); it is then emitted and its bytes are forgotten.

Decoding maps ids to bytes and feeds them to an incremental UTF-8 decoder, whose state is one unfinished character.
"""

from __future__ import annotations

import codecs
import heapq
import json
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from hexcadence.llm.base import map_rows

#: Fixed value: the pre-tokenisation pattern of byte-level BPE vocabularies.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

CHUNK_CHARS = 1 << 18  #: characters the splitter reads at once
WINDOW_BYTES = 1 << 12  #: bytes the merger holds besides the lookahead
SHORT_BYTES = 96  #: pieces up to this length are merged side by side; the result does not depend on it
CACHE_PIECES = 150_000  #: encoded pieces a task remembers
_NONE = np.int64(1 << 40)


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in vocabulary files: itself if printable, else the next from U+0100."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    letters, spare = [], 256
    for b in range(256):
        letters.append(chr(b if b in plain else spare))
        spare += b not in plain
    return letters


class Merges:
    """A vocabulary file's merges as arrays, and what follows from them."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        byte_of = {c: b for b, c in enumerate(_byte_letters())}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.byte_id = np.array([vocab[c] for c in _byte_letters()], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.rules = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        # (left, right) -> rank; the table is sorted by pair for vector lookups.
        self.rank_of = {(a, b): r for r, (a, b, _) in reversed(list(enumerate(self.rules)))}
        key = np.array([a << 20 | b for a, b, _ in self.rules], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.made = np.array([c for _, _, c in self.rules], np.int64)

    @cached_property
    def lookahead(self) -> int:
        """Bytes to the right of a token that can influence whether it stays.

        A token t stops being a candidate when it, or an inner part q on its right edge, merges with a right
        neighbour z by a rule that comes before the one that would have used q. Whether z is there depends on its
        own bytes and, by the same argument, on what lies right of z, but only by rules of lower rank. So ranks
        fall strictly along such a chain, and its longest reach in bytes follows in one pass over the rules:
        reach(rule (q, z)) = len(z) + the reach of z over all rules before it.
        """
        n = len(self.bytes_of)
        own = [0] * n  # longest reach of the rules so far whose left part is this token
        inner = [0] * n  # the same for parts on its right edge, before the rules that used them
        length = self.lengths
        for a, b, c in self.rules:
            reach = int(length[b]) + max(own[b], inner[b])
            # c's right edge holds b; up to this rule, b could have merged to the right.
            inner[c] = max(inner[c], own[b], inner[b])
            own[a] = max(own[a], reach)
        return max(map(max, zip(own, inner, strict=True)))

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of short pieces, packed: all pieces take their best merge at once, round by round."""
        if not pieces:
            return []
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        piece = np.repeat(np.arange(len(pieces)), lengths)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        last = np.empty(len(ids), bool)
        np.not_equal(piece[1:], piece[:-1], out=last[:-1])
        last[-1:] = True
        rank = np.full(len(ids), _NONE)
        inner = np.flatnonzero(~last)
        rank[inner] = self.ranks_of(ids[inner], ids[inner + 1])
        while len(ids):
            first = np.flatnonzero(np.r_[True, piece[1:] != piece[:-1]])
            best = np.minimum.reduceat(rank, first)
            counts = np.diff(np.r_[first, len(ids)])
            if (best == _NONE).any():
                over = np.repeat(best == _NONE, counts)
                done.append((piece[over], ids[over]))
                ids, piece, rank = ids[~over], piece[~over], rank[~over]
                best, counts = best[best != _NONE], counts[best != _NONE]
                if not len(ids):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, counts))
            hit = hit[np.r_[True, piece[hit[1:]] != piece[hit[:-1]]]]  # the leftmost of each piece
            ids[hit] = self.made[rank[hit]]
            stay = np.ones(len(ids), bool)
            stay[hit + 1] = False
            at = hit - np.arange(len(hit))  # where the merged tokens are once the right parts are gone
            ids, piece, rank = ids[stay], piece[stay], rank[stay]
            for i in (at, at - 1):
                i = i[i >= 0]
                ok = i + 1 < len(ids)
                ok[ok] = piece[i[ok]] == piece[i[ok] + 1]
                rank[i[~ok]] = _NONE
                rank[i[ok]] = self.ranks_of(ids[i[ok]], ids[i[ok] + 1])
        where, ids = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(where, kind="stable")
        packed, ends = ids[order].astype("<u4").tobytes(), np.cumsum(np.bincount(where, minlength=len(pieces))) * 4
        return [packed[a:b] for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True)]

    def merge_one(self, data: bytes) -> list[int]:
        """Ids of one run of bytes: a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(data, np.uint8)].tolist()
        n, get = len(ids), self.rank_of.get
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(r, i) for i in range(n - 1) if (r := get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            a, b, made = self.rules[r]
            j = right[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            right[i] = k = right[j]
            if k >= 0:
                left[k] = i
                if (s := get((made, ids[k]))) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := left[i]) >= 0 and (s := get((ids[h], made))) is not None:
                heapq.heappush(heap, (s, h))
        return [x for x in ids if x >= 0]


class Transducer:
    """Tokens of one piece whose bytes come bit by bit; holds at most ``window`` + lookahead bytes."""

    def __init__(self, merges: Merges, lookahead: int, window: int = WINDOW_BYTES):
        self.merges, self.lookahead, self.window, self.held = merges, lookahead, window, b""

    def feed(self, data: bytes) -> Iterator[int]:
        view = memoryview(data)
        for i in range(0, len(view), self.window):
            self.held += bytes(view[i : i + self.window])
            end, used = len(self.held) - self.lookahead, 0
            if end <= 0:
                continue
            for token in self.merges.merge_one(self.held):
                used += int(self.merges.lengths[token])
                if used > end:
                    used -= int(self.merges.lengths[token])
                    break
                yield token
            self.held = self.held[used:]

    def finish(self) -> list[int]:
        out, self.held = self.merges.merge_one(self.held), b""
        return out


@lru_cache(maxsize=2)
def merges(path: str) -> Merges:
    return Merges(path)


class Encoder:
    """Texts to packed ids (little-endian unsigned 32-bit integers)."""

    def __init__(self, path: str, chunk: int = CHUNK_CHARS, window: int = WINDOW_BYTES, short: int = SHORT_BYTES):
        import regex

        self.merges = merges(path)
        self.lookahead = self.merges.lookahead
        self.chunk, self.window, self.short = chunk, window, short
        self.find, self.cache = regex.compile(PIECES), {}
        self.special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.merges.special, key=len, reverse=True))) + ")"
        ) if self.merges.special else None

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Stable pieces, chunk by chunk. A piece that a chunk doesn't finish is read again with more text."""
        start, step = 0, self.chunk
        while len(text) - start > step:
            part = text[start : start + step]
            found = self.find.findall(part)
            # The last piece may go on. One that starts in the last two characters may be a contraction cut short.
            end = len(part) - len(found.pop())
            while found and end - len(found[-1]) + 3 > len(part):
                end -= len(found.pop())
            if found:
                yield found
                start, step = start + end, self.chunk
            else:
                step *= 2
        yield self.find.findall(text[start:])

    def _long(self, data: bytes) -> bytes:
        machine = Transducer(self.merges, self.lookahead, self.window)
        return np.array([*machine.feed(data), *machine.finish()], "<u4").tobytes()

    def _learn(self, pieces: Iterable[str]) -> None:
        cache = self.cache
        short, long = [], []
        for p in pieces:
            data = p.encode("utf-8", "surrogatepass")
            if len(data) <= self.short:
                short.append((p, data))
            else:
                long.append((p, data))
        for (p, _), ids in zip(short, self.merges.merge_many([d for _, d in short]), strict=True):
            cache[p] = ids
        for p, data in long:
            cache[p] = self._long(data)

    def batch(self, texts: list[str | None]) -> list[bytes]:
        parts: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        held = 0
        for i, text in enumerate(texts):
            for j, segment in enumerate(self.special.split(text or "") if self.special else [text or ""]):
                if j % 2:
                    waiting.append((i, [segment]))
                    self.cache.setdefault(segment, np.array([self.merges.special[segment]], "<u4").tobytes())
                    continue
                for found in self.pieces(segment):
                    waiting.append((i, found))
                    held += len(found)
                    if held > CACHE_PIECES:
                        self._emit(waiting, parts)
                        waiting, held = [], 0
        self._emit(waiting, parts)
        return [b"".join(p) for p in parts]

    def _emit(self, waiting: list[tuple[int, list[str]]], parts: list[list[bytes]]) -> None:
        new = set().union(*(found for _, found in waiting)).difference(self.cache)
        if len(self.cache) + len(new) > 2 * CACHE_PIECES:
            self.cache.clear()
            new = set().union(*(found for _, found in waiting))
            for s, i in self.merges.special.items():
                self.cache[s] = np.array([i], "<u4").tobytes()
            new.difference_update(self.cache)
        self._learn(new)
        get = self.cache.__getitem__
        for i, found in waiting:
            parts[i].append(b"".join(map(get, found)))


class Decoder:
    """Packed ids to text: ids give bytes, an incremental decoder gives text; bad bytes become U+FFFD."""

    def __init__(self, path: str, block: int = 1 << 16):
        self.bytes_of, self.block = merges(path).bytes_of, block

    def text(self, packed: bytes) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        ids = np.frombuffer(packed, "<u4")
        known, out = self.bytes_of, []
        for i in range(0, len(ids), self.block):
            part = ids[i : i + self.block]
            part = part[part < len(known)]
            out.append(machine.decode(b"".join(map(known.__getitem__, part.tolist()))))
        out.append(machine.decode(b"", True))
        return "".join(out)


TOKENS = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("token_ids", T.BinaryType())])


def encode(df: DataFrame, text: str, vocab: str, into: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """Add ``into``: n_tokens, and token_ids packed as little-endian unsigned 32-bit integers.

    ``vocab`` is the path of a vocabulary file that every executor can open. Strings of the file's special tokens
    become those tokens. Null and empty texts give no tokens. Texts of any length are read chunk by chunk. Rows stay
    where they are: nothing is shuffled, repeated rows are encoded again (a task remembers pieces, not texts).
    """

    def make():
        encoder = Encoder(vocab)

        def run(texts: list[str | None]) -> pa.Array:
            packed = encoder.batch(texts)
            return pa.StructArray.from_arrays(
                [pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())],
                names=["n_tokens", "token_ids"],
            )

        return run

    return map_rows(df, [text], into, TOKENS, make, keep)


def round_trip(df: DataFrame, text: str, vocab: str, into: str = "tokens", keep: list[str] | None = None) -> DataFrame:
    """As ``encode``, with ``text`` beside the ids: what ``decode`` makes of them.

    Both run in one pass of one Python process, so a core holds the vocabulary and a batch once.
    """

    def make():
        encoder, decoder = Encoder(vocab), Decoder(vocab)

        def run(texts: list[str | None]) -> pa.Array:
            packed = encoder.batch(texts)
            del texts[:]  # a long text is not held beside its tokens and their text
            return pa.StructArray.from_arrays(
                [
                    pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array(packed, pa.binary()),
                    pa.array(map(decoder.text, packed), pa.string(), size=len(packed)),
                ],
                names=["n_tokens", "token_ids", "text"],
            )

        return run

    return map_rows(df, [text], into, T.StructType([*TOKENS, T.StructField("text", T.StringType())]), make, keep)


def decode(df: DataFrame, ids: str, vocab: str, into: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``into``: the text of packed ids. Unknown ids give nothing, null ids an empty text, bad bytes U+FFFD."""

    def make():
        decoder = Decoder(vocab)
        return lambda packed: pa.array([decoder.text(p or b"") for p in packed], pa.string())

    return map_rows(df, [ids], into, T.StringType(), make, keep)
