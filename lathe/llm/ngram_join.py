"""N-gram Jaccard self-join: rare-first prefixes with length, positional and suffix filters.

A text's set holds its distinct word n-grams (the whole sequence, if shorter). Texts link when
den * |intersection| >= num * |union|; classes of linked texts are the connected components.

1. Equal texts become one node, by a shuffle on their hashes. Each task sorts the n-grams of its
   texts, a chunk of about CHUNK of them at a time, into buckets whose number grows with the input
   (some dozens for each n-gram), and sends the chunk's buckets, packed, to ranges of them.
2. Each range adds up how many texts hold a bucket and returns to each chunk those that two or more
   texts hold. Nothing is broadcast; a bucket that all texts hold has one entry for each chunk.
3. Each chunk orders its texts' n-grams rare first (by count, then bucket). Those that one text
   holds come first and can't link, so only what is left of a prefix of |x| - ceil(t |x|) + 1 goes on:
   its postings, each with its position and the counts of its suffix in BINS bins.
4. Postings are joined with the most typical text of each n-gram (the one that has it first in its
   order), which is linear in the postings however large a group is. Pairs pass the length filter,
   the positional filter and the suffix filter (the bins' L1 distance bounds how far the suffixes
   differ), and each unordered pair is verified once on its whole texts. Links give components.
5. What the stars may have missed are pairs of different components: postings whose text isn't in
   the component of their n-gram's typical text are joined with all postings of that n-gram (salted
   by how many there are), under all three filters, and verified. So no link between different
   components is lost, and none within a component is needed.

Buckets only relax the filters, as equal n-grams share one: a text with two n-grams in one bucket is
held to as many fewer in common. Nothing is capped. Broadcasts are those of hot n-grams (at most 1000),
hot texts' salts (at most 500) and tables counted to have at most `SMALL` rows. Lineage is cut with
checkpoint().

Defined results: null, empty and wordless texts have 0 n-grams, link with nothing and are their own
component; equal rows are one node; rows that share an id but not the text are told apart; ids that
are null are ignored in a component's smallest id. Extra columns are left out.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.textops import trim, utf8
from lathe.session import ensure_checkpoint_dir, release

#: N-grams that a task sorts at once.
CHUNK = 1 << 20
BINS = 16
#: Rows of a table that may be broadcast.
SMALL = 200_000
_RANGE_BYTES = 16 << 20
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def gram_set(raw: bytes | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word n-grams."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=len(words))], dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    g = h[: len(h) - n + 1] * _A
    for k in range(1, n):
        g = (g ^ (g >> np.uint64(29))) * _B + h[k : len(h) - n + 1 + k] * _C
    g ^= g >> np.uint64(32)
    return np.unique(g * _A)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers as compressed planes of their bytes."""
    values = np.ascontiguousarray(values, dtype="<u8")
    if not len(values):
        return b""
    wide = max(1, -(-int(values.max()).bit_length() // 8))
    planes = values.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes()
    return struct.pack("<IB", len(values), wide) + pa.Codec("zstd", compression_level=1).compress(planes, asbytes=True)


def unpacked(raw: bytes) -> np.ndarray:
    if not raw:
        return np.empty(0, np.uint64)
    size, wide = struct.unpack_from("<IB", raw)
    planes = pa.Codec("zstd").decompress(raw[5:], size * wide, asbytes=True)
    out = np.zeros((size, 8), np.uint8)
    out[:, :wide] = np.frombuffer(planes, np.uint8).reshape(wide, size).T
    return out.view("<u8").ravel()


def steps(ascending: np.ndarray) -> bytes:
    """Ascending whole numbers, packed."""
    return packed(np.diff(ascending, prepend=np.zeros(1, ascending.dtype)))


def climbed(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked(raw), dtype=np.uint64)


def _runs(lengths: np.ndarray) -> np.ndarray:
    """0, 1, .. for each length in turn."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


class Chunk:
    """Texts whose n-grams are sorted together."""

    def __init__(self, number: int, bits: int):
        self.number, self.bits = number, bits
        self.buckets: list[np.ndarray] = []
        self.sizes: list[int] = []
        self.distinct: list[int] = []
        self.held = 0

    def add(self, grams: np.ndarray) -> int:
        """Takes a text's n-grams; its node."""
        b = grams >> np.uint64(64 - self.bits)
        if len(b):
            b = b[np.concatenate([[True], b[1:] != b[:-1]])]
        self.buckets.append(b)
        self.sizes.append(len(grams))
        self.distinct.append(len(b))
        self.held += len(b)
        return (self.number << 22) + len(self.sizes) - 1

    @property
    def full(self) -> bool:
        return self.held >= CHUNK or len(self.sizes) >= CHUNK

    def rows(self, ranges: int) -> Iterator[tuple]:
        """(r, at, a, b, c, d): a row for each range, and one (r = -1) that says whose the buckets are."""
        if not self.held:
            return
        every = np.concatenate(self.buckets)
        order = np.argsort(every, kind="stable")
        every, owner = every[order], np.repeat(np.arange(len(self.sizes)), self.distinct)[order]
        first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
        bucket, times = every[first], np.diff(np.append(first, len(every)))
        yield -1, -1, packed(owner), packed(times), packed(np.array(self.sizes)), packed(np.array(self.distinct))
        low = self.bits - ranges.bit_length() + 1
        cuts = np.searchsorted(bucket, np.arange(ranges + 1, dtype=np.uint64) << np.uint64(low))
        for r, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if b > a:
                yield r, a, steps(bucket[a:b] - np.uint64(r << low)), packed(times[a:b]), None, None


def shared_of(parts: list[tuple[bytes, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk's (buckets, counts) of one range: places, sums and values of those that several texts hold."""
    buckets, counts = [climbed(b) for b, _ in parts], [unpacked(c) for _, c in parts]
    every, place = np.unique(np.concatenate(buckets), return_inverse=True)
    total = np.zeros(len(every), np.uint64)
    np.add.at(total, place, np.concatenate(counts))
    at = 0
    for b in buckets:
        sums = total[place[at : at + len(b)]]
        some = np.flatnonzero(sums > 1)
        yield some, sums[some], b[some]
        at += len(b)


def prefix_postings(owner, times, sizes, distinct, shared, num: int, den: int):
    """(text, position, bucket, suffix length, suffix bins) arrays of a chunk's prefixes.

    `shared`: [(first place, places, counts, buckets)] of the ranges.
    """
    place = np.concatenate([at + p.astype(np.int64) for at, p, _, _ in shared])
    count, bucket = (np.concatenate([s[k] for s in shared]) for k in (2, 3))
    starts = np.cumsum(times) - times
    n = times[place]
    text = owner[np.repeat(starts[place], n) + _runs(n)]
    count, bucket = np.repeat(count, n), np.repeat(bucket, n)
    order = np.lexsort((bucket, count, text))
    text, bucket = text[order], bucket[order]
    held = np.bincount(text, minlength=len(sizes))
    rank = _runs(held)  # place among the text's shared n-grams
    alone = distinct - held
    prefix = sizes - -(-num * sizes // den) + 1
    position = alone[text] + rank
    chosen = np.flatnonzero(position < prefix[text])
    ends = np.cumsum(held)
    one_hot = np.zeros((len(chosen), BINS), np.int64)
    bins = (bucket & np.uint64(BINS - 1)).astype(np.int64)
    for t in np.unique(text[chosen]).tolist():
        a, b = ends[t] - held[t], ends[t]
        mine = np.searchsorted(chosen, [a, b])
        k = mine[1] - mine[0]
        first = np.zeros((k, BINS), np.int64)
        first[np.arange(k), bins[a : a + k]] = 1
        one_hot[mine[0] : mine[1]] = np.bincount(bins[a:b], minlength=BINS) - np.cumsum(first, axis=0)
    return text[chosen], position[chosen], bucket[chosen], held[text[chosen]] - rank[chosen] - 1, one_hot


def _hashes(text_col: str) -> list[Column]:
    return [F.xxhash64(F.col(text_col)).alias("_h1"), F.xxhash64(F.lit(1), F.col(text_col)).alias("_h2")]


def index(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, postings): (_node, _h1, _h2, _n, _least id) of every distinct text, and
    (_gram, _node, _n, _pos, _rest, _slack, _bins) of prefix n-grams that several texts hold."""
    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_raw"), *_hashes(text_col))
    size = narrow.agg(F.coalesce(F.sum(F.octet_length("_raw")), F.lit(0)).alias("b")).first()["b"]
    bits = max(24, min(56, (8 * size).bit_length()))
    ranges = 1 << max(5, (size // _RANGE_BYTES).bit_length())
    texts = narrow.groupBy("_h1", "_h2").agg(F.min("_id").alias("_least"), F.first("_raw").alias("_raw"))
    texts = texts.select("_h1", "_h2", "_least", "_raw")
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["chunk", "r", "at", "a", "b", "c", "d"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    of_text = ["_h1", "_h2", "_least", "_node", "_n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = iter(range(TaskContext.get().partitionId() << 16, 1 << 62))
        chunk, id_type = Chunk(next(numbers), bits), None

        def flush() -> pa.RecordBatch:
            rows = [(chunk.number, *r) for r in chunk.rows(ranges)]
            made = [pa.array(column, t) for column, t in zip(zip(*rows, strict=True), types, strict=True)]
            return pa.RecordBatch.from_arrays([*made, pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), id_type), pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.int64())], names + of_text)

        for batch in batches:
            id_type, nodes, sizes = batch.column(2).type, [], []
            for t in utf8(batch.column(3)):
                if chunk.full:
                    if chunk.held:
                        yield flush()
                    chunk = Chunk(next(numbers), bits)
                grams = gram_set(t, n)
                nodes.append(chunk.add(grams))
                sizes.append(len(grams))
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays([*(pa.nulls(m, t) for t in types), *batch.columns[:3], pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())], names + of_text)
        if chunk.held:
            yield flush()
        del chunk
        trim()

    both = texts.mapInArrow(run, f"chunk long, r int, at long, a binary, b binary, c binary, d binary, _h1 long, _h2 long, _least {kind}, _node long, _n long").checkpoint()
    del texts
    release(docs.sparkSession)  # the texts' shuffle
    low = bits - ranges.bit_length() + 1

    def add(group: pa.Table) -> pa.Table:
        chunks, at, r = group["chunk"].to_pylist(), group["at"].to_pylist(), group["r"][0].as_py()
        out = []
        for c, k, (place, total, value) in zip(chunks, at, shared_of(list(zip(group["a"].to_pylist(), group["b"].to_pylist(), strict=True))), strict=True):
            if len(place):
                out.append((c, r, k, steps(place.astype(np.uint64)), packed(total), steps(value + np.uint64(r << low)), None))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)

    schema = "chunk long, r int, at long, a binary, b binary, c binary, d binary"
    answers = both.where("r >= 0").select(*names).groupBy("r").applyInArrow(add, schema)
    fields = "_gram long, _node long, _n long, _pos long, _rest long, _slack long, _bins array<int>"

    def order(group: pa.Table) -> pa.Table:
        rows = group.to_pylist()
        whose = next(x for x in rows if x["r"] == -1)
        owner, times, sizes, distinct = (unpacked(whose[k]).astype(np.int64) for k in "abcd")
        shared = [(x["at"], climbed(x["a"]), unpacked(x["b"]), climbed(x["c"])) for x in rows if x["r"] >= 0]
        empty = np.empty(0, np.int64)
        text, position, bucket, rest, bins = prefix_postings(owner, times, sizes, distinct, shared, num, den) if shared else (empty, empty, empty, empty, np.empty((0, BINS), np.int64))
        offsets = pa.array(np.arange(len(text) + 1) * BINS, pa.int32())
        node = (whose["chunk"] << 22) + text
        columns = [bucket.astype(np.int64), node, sizes[text], position, rest, (sizes - distinct)[text]]
        return pa.Table.from_arrays([*(pa.array(x, pa.int64()) for x in columns), pa.ListArray.from_arrays(offsets, pa.array(bins.ravel(), pa.int32()))], ["_gram", "_node", "_n", "_pos", "_rest", "_slack", "_bins"])

    postings = both.where("r = -1").select(*names).unionByName(answers).groupBy("chunk").applyInArrow(order, fields).checkpoint()
    del answers
    release(docs.sparkSession)
    return both.where("r is null").select("_node", "_h1", "_h2", "_n", "_least"), postings


def least_overlap(n_x: Column, n_y: Column, num: int, den: int) -> Column:
    return F.ceil((num * (n_x + n_y)).cast("double") / (num + den))


def fits(num: int, den: int) -> Column:
    """Whether sides a and b of a joined n-gram pass the length, positional and suffix filters."""
    length = (F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num) & (F.col("a") != F.col("b"))
    need = least_overlap(F.col("n_a"), F.col("n_b"), num, den) - F.least("slack_a", "slack_b")
    position = 1 + F.least("rest_a", "rest_b") >= need
    apart = F.aggregate(F.zip_with("bins_a", "bins_b", lambda p, q: F.abs(p - q)), F.lit(0), lambda s, x: s + x)
    return length & position & (2 + F.col("rest_a") + F.col("rest_b") - apart >= 2 * need)


def side(postings: DataFrame, name: str) -> DataFrame:
    """Postings as one side of a join."""
    return postings.select("_gram", F.col("_node").alias(name), *[F.col(f"_{c}").alias(f"{c}_{name}") for c in ("n", "rest", "slack", "bins")], *[F.col(c).alias(f"l_{name}") for c in postings.columns if c == "_label"])


def once(pairs: DataFrame) -> DataFrame:
    """(a, b) with each unordered pair once; where both orders are there, one of them."""
    return pairs.groupBy(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.*")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): label is the smallest node they are connected to.

    Alternating large-star and small-star contraction; each round is checkpointed.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().checkpoint()
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        e = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = e.where("u <> v").distinct().checkpoint()
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("h")).first()
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def _verifier(n: int, num: int, den: int):
    memo: dict[bytes, np.ndarray] = {}

    def grams(raw: bytes) -> np.ndarray:
        if (g := memo.get(raw)) is None:
            if len(memo) >= 64:
                memo.clear()
            memo[raw] = g = gram_set(raw, n)
        return g

    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(utf8(x), utf8(y), strict=True):
            a, b = grams(a), gram_set(b, n)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out.append(den * both >= num * (len(a) + len(b) - both))
        return pa.array(out, pa.bool_())

    return linked


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of nodes whose whole texts are linked. `pairs` has each unordered pair once;
    a may be in very many, so its text goes to several tasks then."""
    pairs = pairs.checkpoint()
    total = pairs.count()
    if not total:
        return pairs
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("_node")).distinct().join(nodes, "_node").select("_node", "_h1", "_h2", "_least").checkpoint()
    if wanted.count() <= SMALL:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_raw"), *_hashes(text_col))
    same = (texts["_h1"] == wanted["_h1"]) & (texts["_h2"] == wanted["_h2"]) & texts["_id"].eqNullSafe(wanted["_least"])
    texts = texts.join(wanted, same).groupBy("_node").agg(F.first("_raw").alias("_raw")).checkpoint()
    release(docs.sparkSession)
    hot = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") * 500 > total).select("a", F.ceil(F.col("_c") * 500 / total).cast("int").alias("_salts"))
    hot = F.broadcast(hot)
    salt = F.pmod(F.xxhash64("b"), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")
    left = texts.select(F.col("_node").alias("a"), F.col("_raw").alias("_raw_a")).join(hot, "a", "left")
    left = left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    right = pairs.join(hot, "a", "left").withColumn("_salt", salt).drop("_salts").join(texts.select(F.col("_node").alias("b"), F.col("_raw").alias("_raw_b")), "b")
    return right.join(left, ["a", "_salt"]).where(_verifier(n, num, den)(F.col("_raw_a"), F.col("_raw_b"))).select("a", "b")


def star_pairs(postings: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(shared, hot, pairs): postings of n-grams that several prefixes hold, marked where typical; the
    hottest n-grams (1000 at most); and pairs of typical texts with others that pass the filters."""
    rank = F.col("_pos") * F.lit(1 << 40) + F.pmod(F.xxhash64("_node"), F.lit(1 << 40))
    total = postings.count()
    typical = postings.groupBy("_gram").agg(F.count(F.lit(1)).alias("_c"), F.min(rank).alias("_first")).where("_c > 1").checkpoint()
    hot = F.broadcast(typical.where(F.col("_c") * 1000 > F.lit(total)).select("_gram", "_first"))
    usual = typical.where(F.col("_c") * 1000 <= F.lit(total)).select("_gram", "_first")
    shared = postings.join(hot, "_gram").unionByName(postings.join(hot.select("_gram"), "_gram", "left_anti").join(usual, "_gram"))
    shared = shared.withColumn("_typical", rank == F.col("_first")).drop("_first").checkpoint()
    hot = F.broadcast(hot.select("_gram"))
    centres, others = side(shared.where("_typical"), "a"), side(shared.where("not _typical"), "b")
    joined = others.join(F.broadcast(centres.join(hot, "_gram", "left_semi")), "_gram").unionByName(
        others.join(hot, "_gram", "left_anti").join(centres.join(hot, "_gram", "left_anti"), "_gram")
    )
    return shared, hot, once(joined.where(fits(num, den)).select("a", "b"))


def residual_pairs(shared: DataFrame, hot: DataFrame, label: DataFrame, done: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that hold an n-gram and pass the filters, without those `done`."""
    named = shared.join(label.select(F.col("node").alias("_node"), F.col("label").alias("_of")), "_node", "left").withColumn("_label", F.coalesce("_of", "_node")).drop("_of").checkpoint()
    main = named.where("_typical").select("_gram", F.col("_label").alias("_main"))
    split = named.join(F.broadcast(main.join(hot, "_gram", "left_semi")), "_gram").unionByName(
        named.join(hot, "_gram", "left_anti").join(main.join(hot, "_gram", "left_anti"), "_gram")
    )
    split = split.where("_label <> _main").checkpoint()
    # an n-gram with many such postings is dealt to several tasks, each of which gets all its partners
    salts = split.groupBy("_gram").agg(F.ceil(F.count(F.lit(1)) / 1000).cast("int").alias("_salts")).where("_salts > 1")
    salts = F.broadcast(salts) if split.count() <= 1000 * SMALL else salts
    some = split.select("_gram").distinct()
    main_of = split.select("_gram", "_main").distinct()
    dealt = side(split, "b").join(main_of, "_gram").join(salts, "_gram", "left").withColumn("_salt", F.pmod(F.xxhash64("b"), F.coalesce("_salts", F.lit(1)).cast("long")).cast("int")).drop("_salts")
    partners = side(named.join(some, "_gram", "left_semi"), "a").join(salts, "_gram", "left")
    partners = partners.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    one_side = (F.col("l_a") == F.col("_main")) | (F.col("a") < F.col("b"))
    found = once(dealt.join(partners, ["_gram", "_salt"]).where((F.col("l_a") != F.col("l_b")) & one_side & fits(num, den)).select("a", "b"))
    return found.join(done.select("a", "b").unionByName(done.select(F.col("b").alias("a"), F.col("a").alias("b"))), ["a", "b"], "left_anti")


def _linked(docs: DataFrame, id_col: str, text_col: str, n: int, num: int, den: int) -> DataFrame:
    """The nodes (_node, _h1, _h2, _n, _least) with label (null for wordless texts) and component_id."""
    ensure_checkpoint_dir(docs.sparkSession)
    nodes, postings = index(docs, id_col, text_col, n, num, den)
    shared, hot, pairs = star_pairs(postings, num, den)
    pairs = pairs.checkpoint()
    links = verified(pairs, nodes, docs, id_col, text_col, n, num, den).checkpoint()
    label = components(links).checkpoint()
    found = verified(residual_pairs(shared, hot, label, pairs, num, den), nodes, docs, id_col, text_col, n, num, den).checkpoint()
    if not found.isEmpty():
        label = components(found.unionByName(label.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")))).checkpoint()

    release(docs.sparkSession)
    own = nodes.join(label.withColumnRenamed("node", "_node"), "_node", "left").checkpoint()
    linked, alone = own.where("label is not null"), own.where("label is null")
    every = label.count()
    least = linked.groupBy("label").agg(F.min("_least").alias("component_id"), F.count(F.lit(1)).alias("_c")).checkpoint()
    large = F.broadcast(least.where(F.col("_c") * 1000 > F.lit(every)).drop("_c"))  # at most 1000 components
    few = least.where(F.col("_c") * 1000 <= F.lit(every)).drop("_c")
    columns = [*nodes.columns, "label", "component_id"]
    alone = alone.withColumn("label", F.when(F.col("_n") > 0, F.col("_node"))).withColumn("component_id", F.when(F.col("_n") > 0, F.col("_least")))
    named = linked.join(large, "label").select(*columns).unionByName(linked.join(large.select("label"), "label", "left_anti").join(few, "label").select(*columns))
    return named.unionByName(alone.select(*columns))


def linked_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """A row for each row of `docs`: id, n_shingles, component_id (the smallest id linked with it)."""
    linked = _linked(docs, id_col, text_col, n, num, den).select("_h1", "_h2", "_n", "component_id")
    rows = docs.select(F.col(id_col).alias("_id"), *_hashes(text_col))
    return rows.join(linked, ["_h1", "_h2"]).select(F.col("_id").alias(id_col), F.col("_n").alias("n_shingles"), F.coalesce("component_id", "_id").alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of `docs`, one of each component: that of the smallest id (then text hash). Wordless rows stay."""
    linked = _linked(docs, id_col, text_col, n, num, den).where("label is not null").checkpoint()
    kept = linked.groupBy("label").agg(F.min(F.struct("_least", "_h1", "_h2")).alias("x")).select("x.*")
    words = F.coalesce(F.translate(F.col(text_col), " \t\n\x0b\f\r", ""), F.lit("")) != ""
    ids = docs.where(words).select(F.col(id_col).alias("_id"), *_hashes(text_col)).groupBy("_id", "_h1", "_h2").agg(F.count(F.lit(1)).alias("_c"))
    gone = ids.join(kept, (ids["_h1"] == kept["_h1"]) & (ids["_h2"] == kept["_h2"]) & ids["_id"].eqNullSafe(kept["_least"]), "left_anti").select(*ids.columns).checkpoint()
    if gone.count() <= SMALL:
        gone = F.broadcast(gone)
    h1, h2 = F.xxhash64(F.col(text_col)), F.xxhash64(F.lit(1), F.col(text_col))
    same = F.col(f"`{id_col}`").eqNullSafe(gone["_id"]) & (h1 == gone["_h1"]) & (h2 == gone["_h2"])
    out = docs.where(~words).unionByName(docs.where(words).join(gone, same, "left_anti"))
    if ids.where("_c > 1").isEmpty():
        return out
    # rows that agree in id and text: one of them stays, whatever else they hold
    held = out.where(words).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(f"`{id_col}`").alias("_of"), *_hashes(text_col))
    return out.where(~words).unionByName(held.groupBy("_of", "_h1", "_h2").agg(F.first("_row").alias("_row")).select("_row.*"))


def brute_force(texts: list[tuple[int, str | None]], n: int = 3, num: int = 90, den: int = 100) -> dict[int, tuple[int, int]]:
    """id -> (set size, component id), by all pairs, for tests."""
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    root = {i: i for i, _ in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and min(len(a), len(b)) * den >= max(len(a), len(b)) * num:
                both = len(a & b)
                if den * both >= num * (len(a) + len(b) - both):
                    p, q = sorted((top(ids[x]), top(ids[y])))
                    root[q] = p
    return {i: (len(sets[i]), top(i)) for i in ids}
