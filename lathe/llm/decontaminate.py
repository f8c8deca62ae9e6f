"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Words are maximal runs of ASCII digits, ASCII letters (lower-cased) and non-ASCII characters. A
window is `n` consecutive words of one benchmark item, or the whole item when it has fewer (but
some). Every task maps the words of its documents to the benchmark's vocabulary, hashes only those
windows all of whose words are known, looks the hashes up in the sorted hash set, and verifies each
hit word by word. Whole texts are scanned; nothing is shuffled.

Defined results: a null or empty text has no words and no hits; a null item has no windows; an item
without an id counts as one item, last and without a name; items with equal windows are all reported; repeated rows each get their own result; an empty benchmark
hits nothing; extra columns of the input pass through unchanged, and a column of the name asked for
as output is replaced.

The set is broadcast only while it is at most `max_windows` windows (its bytes are bounded by
8 * (n + 2) * max_windows plus the vocabulary). A larger benchmark is scanned in blocks of that
size, one pass for each, and the hit words of all passes are united.
"""

from __future__ import annotations

import hashlib
import re
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.textops import utf8

#: Everything but digits, letters and bytes of non-ASCII characters becomes a space; A-Z become a-z.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)

RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,last:long>>"


def words_of(raw: bytes | None) -> list[bytes]:
    """The normalised words of a text's UTF-8 bytes."""
    return raw.translate(_FOLD).split() if raw else []


def in_order(items: set[str | None]) -> list[str | None]:
    return sorted(items, key=lambda x: (x is None, x or ""))


class WindowSet:
    """Windows of the benchmark as word ids, by length, with sorted hashes and the items of each."""

    def __init__(self, items: list[tuple[str, bytes | None]], n: int = 10):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item, raw in items:
            ids = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(raw))
            size = min(n, len(ids))
            for i in range(len(ids) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(ids[i : i + size], set()).add(item)
        self.by_length = []
        for size in sorted(found):
            windows = list(found[size])
            matrix = np.array(windows, dtype=np.int64).reshape(len(windows), size)
            hashes = self._hash(matrix.T)
            order = np.argsort(hashes, kind="stable")
            self.by_length.append((size, hashes[order], matrix[order], [in_order(found[size][windows[i]]) for i in order]))

    @staticmethod
    def _hash(columns) -> np.ndarray:
        h = None
        for c in columns:
            c = c.astype(np.uint64) + np.uint64(1)
            h = c if h is None else (h ^ (h >> np.uint64(29))) * _MULTIPLIER + c
        return h

    def scan(self, texts: list[bytes | None]):
        """For each text: words, hit words, sorted items, and the hit spans as [first, last] words."""
        words = [words_of(t) for t in texts]
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        get, ids = self.vocabulary.get, []
        for w in words:
            ids.append(np.fromiter(map(get, w, repeat(-1)), dtype=np.int64, count=len(w)))
            ids.append(np.array([-1]))  # no window spans two documents
        flat = np.concatenate(ids) if ids else np.empty(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
        known = np.concatenate([[0], np.cumsum(flat >= 0)])
        hit, owned = np.zeros(len(flat), dtype=bool), [set() for _ in texts]
        for size, hashes, matrix, items in self.by_length:
            at = np.flatnonzero(known[size:] - known[:-size] == size) if len(flat) >= size else np.empty(0, np.int64)
            if not len(at):
                continue
            h = self._hash(flat[at + k] for k in range(size))
            low, high = np.searchsorted(hashes, h, "left"), np.searchsorted(hashes, h, "right")
            while (some := low < high).any():  # equal hashes of different windows are tried in turn
                at, low, high, h = at[some], low[some], high[some], h[some]
                same = (matrix[low] == flat[at[:, None] + np.arange(size)]).all(axis=1)
                for i in np.unique(at[same]):
                    hit[i : i + size] = True
                docs = np.searchsorted(starts, at[same], "right") - 1
                for d, w in set(zip(docs.tolist(), low[same].tolist(), strict=True)):
                    owned[d].update(items[w])
                low = np.where(same, high, low + 1)
        out = []
        for d, (s, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
            mine = hit[s : s + n]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.astype(np.int8), [0]]))) if owned[d] else np.empty(0, np.int64)
            spans = [{"first": int(a), "last": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            out.append((n, int(mine.sum()), in_order(owned[d]), spans))
        return out


def _scanner(windows: WindowSet):
    @F.arrow_udf(RESULT)
    def scan(text: pa.Array) -> pa.Array:
        texts = utf8(text)
        found = [x for a in range(0, len(texts), 512) for x in windows.scan(texts[a : a + 512])]
        kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())])))])
        return pa.array([dict(zip(("n_words", "n_hit", "items", "spans"), x, strict=True)) for x in found], type=kind)

    return scan


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 10, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "hits", max_windows: int = 2_000_000) -> DataFrame:
    """`docs` with a struct column `out_col`: n_words, n_hit, items (sorted), spans of hit words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("_item"), F.col(item_text_col).alias("_text"))
    weight = F.length(F.coalesce(F.col("_text"), F.lit("")))  # a text has at most as many windows as characters
    total = items.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(total) // max_windows))
    parts = [items if blocks == 1 else items.where(F.pmod(F.xxhash64("_item", "_text"), F.lit(blocks)) == b) for b in range(blocks)]
    columns = [F.col("_row").getField(c).alias(c) for c in docs.columns if c != out_col]
    result = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text_col).alias("_text"))  # apart from the columns made here
    names = []
    for b, part in enumerate(parts):
        windows = WindowSet([(r["_item"], r["_text"].encode() if r["_text"] is not None else None) for r in part.collect()], n)
        names.append(f"_hits_{b}")
        result = result.withColumn(names[-1], _scanner(windows)(F.col("_text")))
        if b % 4 == 3:
            result = result.checkpoint()  # bounds the sets that one task holds at once
    if blocks == 1:
        return result.select(*columns, F.col("_hits_0").alias(out_col))
    every = F.array_sort(F.flatten(F.array(*[F.col(f"{x}.spans") for x in names])))
    united = F.aggregate(
        every,
        F.struct(F.lit(-1).cast("long").alias("to"), F.lit(0).cast("long").alias("n"), F.expr("cast(array() as array<struct<first:long,last:long>>)").alias("spans")),
        lambda a, s: F.when(
            s["first"] > a["to"] + 1, F.struct(s["last"].alias("to"), (a["n"] + s["last"] - s["first"] + 1).alias("n"), F.concat(a["spans"], F.array(s)).alias("spans"))
        ).otherwise(
            F.struct(
                F.greatest(a["to"], s["last"]).alias("to"),
                (a["n"] + F.greatest(a["to"], s["last"]) - a["to"]).alias("n"),
                F.when(F.size(a["spans"]) == 0, F.array(s))
                .otherwise(F.concat(F.slice(a["spans"], 1, F.size(a["spans"]) - 1), F.array(F.struct(F.element_at(a["spans"], -1)["first"].alias("first"), F.greatest(a["to"], s["last"]).alias("last")))))
                .alias("spans"),
            )
        ),
    )
    names_of = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.col(f"{x}.items") for x in names]))))
    whole = F.struct(F.col(f"{names[0]}.n_words").alias("n_words"), F.col("_united.n").alias("n_hit"), names_of.alias("items"), F.col("_united.spans").alias("spans"))
    return result.withColumn("_united", united).select(*columns, whole.alias(out_col))


def remove_spans(text: str | None, spans) -> str | None:
    """The text without its hit words and what stands between them."""
    if not text or not spans:
        return text
    raw = text.encode()
    at = [m.span() for m in _WORD.finditer(raw)]
    kept, done = [], 0
    for s in spans:
        kept.append(raw[done : at[s["first"]][0]])
        done = at[s["last"]][1]
    return b"".join([*kept, raw[done:]]).decode()


def _cleaner():
    @F.arrow_udf("string")
    def clean(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([remove_spans(t, s) for t, s in zip(text.to_pylist(), spans.to_pylist(), strict=True)], type=pa.string())

    return clean


def decontaminate(docs: DataFrame, benchmark: DataFrame, action: str = "remove_document", max_hit_share: float = 0.0, n: int = 10, text_col: str = "text") -> DataFrame:
    """Documents without benchmark text, with the columns of `docs`.

    remove_document drops a document of whose words more than `max_hit_share` are hit; remove_span
    keeps every document and cuts the hit spans out of its text.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_whole")
    found = find_hits(docs.select(whole, F.col(text_col).alias("_words")), benchmark, n, "_words", out_col="_hits")
    if action == "remove_document":
        return found.where(F.col("_hits.n_hit") <= F.lit(max_hit_share) * F.col("_hits.n_words")).select("_whole.*")
    if action != "remove_span":
        raise ValueError(f"unknown action {action!r}")
    cut = F.when(F.size("_hits.spans") > 0, _cleaner()(F.col("_words"), F.col("_hits.spans"))).otherwise(F.col("_words"))
    return found.select(*[(cut if c == text_col else F.col("_whole").getField(c)).alias(c) for c in docs.columns])


def items_digest(items: Column) -> Column:
    """Lower-case SHA-256 of the comma-joined items."""
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)


def brute_force(texts: list[str | None], items: list[tuple[str, str | None]], n: int = 10) -> list[tuple[int, int, list[str]]]:
    """The definition, word by word, for tests."""
    fold = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = []
    for item, text in items:
        w = fold(text)
        size = min(n, len(w))
        windows += [(item, w[i : i + size]) for i in range(len(w) - size + 1 if size else 0)]
    out = []
    for text in texts:
        w = fold(text)
        hit, mine = set(), set()
        for item, x in windows:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    mine.add(item)
        out.append((len(w), len(hit), in_order(mine)))
    return out


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
