"""Vector bin packing of token sequences, by the dot-product heuristic.

A row's tokens are those of its prompt (which bear no loss) and its text, then one end id. Parts of
long rows that fill a sequence by themselves, within all limits, become one; the rest goes into a
buffer of bounded size. Sequences are filled one at a time under limits on tokens, segments and
loss-bearing tokens: the piece with the largest weighted dot product of its demand and the room left
goes in, until nothing fits or one segment is left; then pieces are cut to fill the gap. Where segments or loss-bearing
tokens run out first, or a task's rows end, the sequence's length is a power of two, which takes no
padding. Each task packs its own rows as they stream by: there is no shuffle, and a task holds a batch
and the buffer.

Defined results: null texts and prompts are empty (a row has its end id at least); repeated rows
are packed each by itself; an empty table gives no pieces; extra columns are left out.
`sequence_id` holds the task's number in its upper bits, so it is stable when a lost task runs
again on the same split.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.llm.textops import trim

_TOKENIZERS: dict[str, _Encoder] = {}
#: Characters whose normal form, lower case and class are the same in every Unicode version.
_PLAIN = re.compile(rb"(?:[\x21-\x7e]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])++")
_ALL_PLAIN = re.compile(rb"(?:[\n\x21-\x7e]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4\xc5][\x80-\xbf])++")
_ODD = re.compile(rb"\xc4[\xb0\xb1]|\xc5[\x89\xbf]|<\|")
#: Bytes of text that are split at once.
_SLICE = 2 << 20
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u017e"
_SPLIT = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\s0-9{_LETTERS}]+|\n")


class _Merges:
    """Byte-pair merges of many words at once: in each round every word merges its best pair."""

    def __init__(self, model: dict):
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        names = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in printable)}
        self.first = np.array([vocab[names[b]] for b in range(256)], dtype=np.int64)
        self.last = np.array([vocab[names[b] + self.suffix] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = np.array([vocab[x] for x, _ in pairs], np.int64), np.array([vocab[y] for _, y in pairs], np.int64)
        merged = np.array([vocab[x + y] for x, y in pairs], np.int64)
        self.bits = 19
        keys = left << 20 | right
        self.keys, self.rank, self.into = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, len(pairs), np.int64), np.zeros(1 << self.bits, np.int64)
        todo, self.probes = np.arange(len(pairs)), 0
        while len(todo):  # open addressing: what finds its place taken tries the next
            at = self._slot(keys[todo], self.probes)
            free = self.keys[at] < 0
            _, one = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[one]
            self.keys[at[won]], self.rank[at[won]], self.into[at[won]] = keys[todo[won]], todo[won], merged[todo[won]]
            todo = np.delete(todo, won)
            self.probes += 1
        self.none = len(pairs)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64) + probe & ((1 << self.bits) - 1)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = self._slot(keys, 0)
        found = self.keys[at]
        for probe in range(1, self.probes):
            miss = np.flatnonzero((found != keys) & (found >= 0))
            if not len(miss):
                break
            at[miss] = self._slot(keys[miss], probe)
            found[miss] = self.keys[at[miss]]
        return np.where(found == keys, self.rank[at], self.none), at

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words in turn, and how many each has."""
        raw = np.frombuffer(("\n".join(words) + "\n").encode(), dtype=np.uint8)  # no word holds a line's end
        breaks = np.flatnonzero(raw == 10)
        sizes, raw = np.diff(breaks, prepend=-1) - 1, raw[raw != 10]
        ends = np.cumsum(sizes) - 1
        ids = self.first[raw]
        ids[ends] = self.last[raw[ends]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        while len(ids):
            pair = np.flatnonzero(word[1:] == word[:-1])
            rank, at = self._find(ids[pair] << 20 | ids[pair + 1])
            some = rank < self.none
            pair, rank, at = pair[some], rank[some], at[some]
            live = np.zeros(len(words), dtype=bool)
            live[word[pair]] = True
            keep = live[word]
            done_ids.append(ids[~keep])
            done_word.append(word[~keep])
            if not len(pair):
                break
            starts = np.flatnonzero(np.concatenate([[True], word[pair][1:] != word[pair][:-1]]))
            best = np.minimum.reduceat(rank << 32 | np.arange(len(rank)), starts) & 0xFFFFFFFF  # the leftmost of equal ones
            ids[pair[best]] = self.into[at[best]]
            keep[pair[best] + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        return ids[np.argsort(word, kind="stable")].astype("<u4"), np.bincount(word, minlength=len(words))


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, .. for each (start, length) in turn."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class _Encoder:
    """Token ids of whole texts.

    Where the vocabulary's normaliser, splitter and merges all stop at white space, a text's ids are
    those of its stretches, joined: Arrow splits a batch and finds its distinct stretches, those met
    before are looked up, new ones of plain characters are merged many at once, and the tokenizer
    itself encodes what is left. The ids known lie in one array, `size` stretches at most; when
    it's full, those that only one slice of texts has asked for are forgotten.
    """

    def __init__(self, path: str, size: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size, self.merges = size, None
        self.memo: dict[bytes, int] = {}
        self._clear()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"].get("end_of_word_suffix") and [x.get("type") for x in (spec["normalizer"] or {}).get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
            self.merges = _Merges(spec["model"])

    def _clear(self) -> None:
        self.memo.clear()
        self.flat, self.starts, self.lengths, self.used = np.empty(1 << 16, "<u4"), np.empty(1 << 12, np.int64), np.empty(1 << 12, np.int64), 0
        self.asked = np.zeros(1 << 12, np.int64)

    def forget(self) -> None:
        """Keeps what several slices have asked for, half of `size` at most."""
        known = len(self.memo)
        asked = self.asked[:known]
        least = max(2, int(np.partition(asked, -self.size // 2)[-self.size // 2]) + 1 if known > self.size // 2 else 2)
        keep = np.flatnonzero(asked >= least)
        names = list(compress(self.memo, (asked >= least).tolist()))
        starts, lengths, flat, asked = self.starts[keep], self.lengths[keep], self.flat, asked[keep]
        self._clear()
        self._store(names, flat[_spread(starts, lengths)], lengths)
        self.asked[: len(names)] = asked // 2 + 1

    def _whole(self, raw: bytes) -> bytes:
        return np.array(self.tokenizer.encode(raw.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _store(self, stretches: list[bytes], ids: np.ndarray, lengths: np.ndarray) -> None:
        known = len(self.memo)
        for name, need in (("flat", self.used + len(ids)), *((n, known + len(stretches)) for n in ("starts", "lengths", "asked"))):
            if need > len(old := getattr(self, name)):
                grown = np.zeros(max(need, 2 * len(old)), old.dtype)
                grown[: len(old)] = old
                setattr(self, name, grown)
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts[known : known + len(stretches)] = self.used + np.cumsum(lengths) - lengths
        self.lengths[known : known + len(stretches)] = lengths
        self.used += len(ids)
        self.memo.update(zip(stretches, range(known, known + len(stretches)), strict=True))

    def _learn(self, stretches: list[bytes]) -> None:
        plain, rest, joined = stretches, [], b"\n".join(stretches)
        if not _ALL_PLAIN.fullmatch(joined) or _ODD.search(joined):
            plain = [x for x in stretches if _PLAIN.fullmatch(x) and not _ODD.search(x)]
            rest = list(set(stretches).difference(plain))
            joined = b"\n".join(plain)
        if plain:
            parts = _SPLIT.findall(joined.decode().lower())
            words = list(set(parts).difference("\n"))
            number = dict(zip(words, range(len(words)), strict=True)) | {"\n": -1}
            at = np.fromiter(map(number.__getitem__, parts), dtype=np.int64, count=len(parts))
            ids, sizes = self.merges.encode(words)
            of = np.cumsum(at < 0)[at >= 0]
            at = at[at >= 0]
            self._store(plain, ids[_spread((np.cumsum(sizes) - sizes)[at], sizes[at])], np.bincount(of, sizes[at], len(plain)).astype(np.int64))
        if rest:
            ids = [np.frombuffer(self._whole(x), "<u4") for x in rest]
            self._store(rest, np.concatenate(ids), np.array([len(x) for x in ids]))

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a string column."""
        if self.merges is None:
            yield from (np.frombuffer(self._whole(t.encode()), "<u4") if t else np.empty(0, "<u4") for t in texts.to_pylist())
            return
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        bounds, most, a = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0, 0
        while a < len(texts):
            most = (bounds[a - 1] if a else 0) + _SLICE
            b = max(a + 1, int(np.searchsorted(bounds, most, "right")))
            yield from self._slice(texts.slice(a, b - a))
            a = b

    def _slice(self, texts: pa.Array) -> Iterator[np.ndarray]:
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.large_binary()).to_pylist()
        found = np.fromiter(map(self.memo.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        new = np.flatnonzero(found < 0)
        if len(new):
            if len(self.memo) + len(new) > self.size:
                self.forget()
                found = np.fromiter(map(self.memo.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
                new = np.flatnonzero(found < 0)
            fresh = [distinct[i] for i in new.tolist()]
            if b"" in fresh:
                self._store([b""], np.empty(0, "<u4"), np.zeros(1, np.int64))
            if learnt := [x for x in fresh if x]:
                self._learn(learnt)
            found[new] = np.fromiter(map(self.memo.__getitem__, fresh), dtype=np.int64, count=len(fresh))
        self.asked[found] += 1
        at = found[coded.indices.to_numpy(zero_copy_only=False)]
        lengths = self.lengths[at]
        ids = self.flat[_spread(self.starts[at], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield ids[a:b]

    def ids_of(self, texts: list[bytes | None]) -> list[bytes]:
        return [x.tobytes() for x in self.encode(pa.array([None if t is None else t.decode() for t in texts], pa.large_string()))]


def encoder(path: str) -> _Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = _Encoder(path)
    return _TOKENIZERS[path]


@dataclass(frozen=True)
class Limits:
    """Of a sequence: tokens, segments, loss-bearing tokens. `buffer`: pieces held for choosing."""

    tokens: int = 2048
    segments: int = 256
    loss_tokens: int = 2048
    buffer: int = 256
    end_id: int = 1


class Piece:
    """Ids of a row from `start` on; those before `prompt` bear no loss."""

    __slots__ = ("key", "ids", "start", "prompt", "total", "length")

    def __init__(self, key: object, ids: bytes, start: int, prompt: int, total: int):
        self.key, self.ids, self.start, self.prompt, self.total, self.length = key, ids, start, prompt, total, len(ids) // 4

    def loss(self) -> int:
        return max(0, self.start + self.length - max(self.start, self.prompt))

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return Piece(self.key, self.ids[: 4 * n], self.start, self.prompt, self.total), Piece(self.key, self.ids[4 * n :], self.start + n, self.prompt, self.total)


class Packer:
    """Fills sequences from a buffer of pieces.

    `choose`: "dot" takes the piece whose demand, in units of the buffer's average piece and at length
    one, has the largest dot product with the room left; "first" the first that fits (for comparison).
    A cut takes the front or the back of a piece, whichever keeps the share of loss-bearing tokens.
    """

    def __init__(self, limits: Limits, choose: str = "dot"):
        self.limits, self.choose = limits, choose
        self.buffer: list[Piece] = []
        self.demand = np.zeros((limits.buffer + 1, 3))  # tokens, segments, loss-bearing tokens

    def _hold(self, piece: Piece) -> None:
        if len(self.buffer) == len(self.demand):
            self.demand = np.concatenate([self.demand, np.zeros_like(self.demand)])
        self.demand[len(self.buffer)] = piece.length, 1, piece.loss()
        self.buffer.append(piece)

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        while piece.length:
            bare = max(0, piece.prompt - piece.start)
            n = min(piece.length, self.limits.tokens, bare + self.limits.loss_tokens)
            part, piece = piece.cut(n) if n < piece.length else (piece, Piece(piece.key, b"", 0, 0, 0))
            if n == self.limits.tokens:
                yield [part]
                continue
            self._hold(part)
            if len(self.buffer) >= self.limits.buffer:
                yield self._bin()

    def flush(self) -> Iterator[list[Piece]]:
        while self.buffer:
            left = int(self.demand[: len(self.buffer), 0].sum())
            yield self._bin(None if left >= self.limits.tokens else 1 << (left.bit_length() - 1))

    def _bin(self, tokens: int | None = None) -> list[Piece]:
        """The next sequence: `tokens` long, or a power of two where another limit comes first."""
        lim, tokens, n = self.limits, tokens or self.limits.tokens, len(self.buffer)
        demand = self.demand[:n]
        cap = np.array([tokens, lim.segments, lim.loss_tokens], dtype=np.float64)
        shape = demand / cap
        shape /= np.maximum(shape.mean(axis=0), 1e-12)  # as multiples of what a piece takes on average
        shape /= np.sqrt((shape * shape).sum(axis=1, keepdims=True))
        length, loss, open_ = demand[:, 0], demand[:, 2], np.ones(n, dtype=bool)
        left, chosen = cap.copy(), []
        while left[1] >= 2 or left[1] >= 1 and self.choose != "dot":  # the last segment is for a cut
            fits = open_ & (length <= left[0]) & (loss <= left[2])
            if self.choose == "dot":
                score = np.where(fits, shape @ (left / cap), -1.0)
                i = int(score.argmax())
            else:
                i = int(fits.argmax())
            if not fits[i]:
                break
            chosen.append(self.buffer[i])
            open_[i] = False
            left -= demand[i]
        rest = list(compress(self.buffer, open_))
        self.demand[: len(rest)] = demand[open_]
        self.buffer = rest
        while left[0] >= 1 and left[1] >= 1 and rest:  # cut pieces to fill the gap
            length, loss = self.demand[: len(rest), 0], self.demand[: len(rest), 2]
            mine = left[0] * loss.sum() / length.sum()  # what the gap would bear on average
            front = np.minimum(np.minimum(left[0], length), length - loss + left[2])
            back = np.minimum(np.minimum(left[0], length), np.where(loss <= left[2], length, left[2]))
            takes = np.concatenate([front, back])
            bears = np.concatenate([np.maximum(0, front - length + loss), np.minimum(back, loss)])
            i = int(np.lexsort((np.abs(bears - mine), -takes))[0])
            if (n := int(takes[i])) < 1:
                break
            i, last = i % len(rest), i >= len(rest)
            if n < rest[i].length:
                part, rest[i] = rest[i].cut(rest[i].length - n)[::-1] if last else rest[i].cut(n)
                self.demand[i] = rest[i].length, 1, rest[i].loss()
            else:
                part = rest.pop(i)
                self.demand[i : len(rest)] = self.demand[i + 1 : len(rest) + 1]
            chosen.append(part)
            left -= part.length, 1, part.loss()
        used = tokens - int(left[0])
        if used & (used - 1) and used < lim.tokens:  # shorter than asked: give back what is beyond a power of two
            beyond = used - (1 << (used.bit_length() - 1))
            while beyond:
                last = chosen.pop()
                if last.length <= beyond:
                    beyond -= last.length
                    self._hold(last)
                else:
                    keep, back = last.cut(last.length - beyond)
                    chosen.append(keep)
                    self._hold(back)
                    beyond = 0
        return chosen


def pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, prompt_share: float = 0.0, limits: Limits | None = None, with_ids: bool = False) -> DataFrame:
    """A row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    The prompt is the text of `prompt_col`; without one, it's `prompt_share` of the text's own ids,
    rounded down, from the first on. `with_ids` adds the piece's token ids. Every token of every row
    lies in exactly one piece.
    """
    limits = limits or Limits()
    key = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {key}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long" + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, packer = encoder(tokenizer_path), Packer(limits)
        end = np.array([limits.end_id], dtype="<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        kind = None
        names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens", *(["ids"] if with_ids else [])]
        out: list[list] = []

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            arrays = [pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:8])]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(x, "<i4") for x in columns[8]], pa.list_(pa.int32())))
            return pa.RecordBatch.from_arrays(arrays, names)

        def take(bins) -> None:
            nonlocal sequence
            for pieces in bins:
                at = 0
                for p in pieces:
                    row = (p.key, p.start, p.length, zlib.crc32(p.ids), p.total, sequence, at, p.loss())
                    out.append((*row, p.ids) if with_ids else row)
                    at += p.length
                sequence += 1

        for batch in batches:
            kind = batch.column(0).type
            heads = (x.tobytes() for x in enc.encode(batch.column(2))) if prompt_col else repeat(b"")
            for k, head, tail in zip(batch.column(0).to_pylist(), heads, enc.encode(batch.column(1)), strict=bool(prompt_col)):
                ids = head + tail.tobytes() + end
                take(packer.add(Piece(k, ids, 0, len(head) // 4 if prompt_col else int(len(ids) // 4 * prompt_share), len(ids) // 4)))
            if out:
                yield rows()
        take(packer.flush())
        if out:
            yield rows()
        enc.forget()
        trim()

    columns = [F.col(id_col), F.col(text_col).cast("string").alias("_text"), *([F.col(prompt_col).cast("string").alias("_prompt")] if prompt_col else [])]
    return docs.select(*columns).mapInArrow(run, schema)
