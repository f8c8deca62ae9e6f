"""URL filters: host and path rules first, then a ratio of two character language models.

Rules (a host and the start of a path) fit a host and its subdomains; the longest that fits wins. What
no rule decides is decided by two smoothed variable-order Markov models of whole urls, as they stand:
scheme, host, path, query and fragment. They learn from weak labels of all distinct urls:

* rejected: urls that a rule blocks, and those whose host holds a seed token;
* accepted: urls that a rule allows, and those without any weak signal (a seed token in the host, or a
  host whose labels look made up: a hyphen inside, a digit, or more than `LONG_LABEL` characters);
* what has a weak signal other than a seed token teaches neither model; the models decide on it.

A model backs off to shorter contexts with Witten-Bell weights and keeps a context only if it was seen
twice, as one seen once tells of one url alone. A url is blocked when the difference of
log-likelihoods, divided by its length, exceeds a limit. The limit is calibrated on all distinct urls
of both kinds that no rule decides, each judged without its own counts: the smaller of the one that
parts them best and the rejected ones' lower quartile, but above the accepted ones' 99.9 % quantile.

Contexts are counted in the tasks and added up by a shuffle. Tables of up to `max_counts` counts go to
the tasks at once; larger ones stay a DataFrame (but for contexts of at most one byte, which are at
most 2 x 257) and are joined to the urls by context.

Defined results: a null url, or one without `://`, has empty host and path and fits no rule; its text
(null: the empty string) is judged as any other; a model without examples of both kinds allows all;
repeated rows each get a result; extra columns pass through, those named as outputs are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.functions.ordered import running_sums
from lathe.llm.textops import utf8
from lathe.session import checkpointed

#: (rule, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: A label of a host longer than this looks made up.
LONG_LABEL = 24
#: Seed tokens of rejected hosts.
SEED_TOKENS = ("casino", "pills", "spam", "poker", "viagra", "porn", "xxx", "jackpot", "payday", "escort", "lottery")


def host_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    lower = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.contains(url, F.lit("://")), lower).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    after = F.substring_index(url, "://", 1)
    rest = F.substring(url, F.length(after) + 4, F.length(url))
    return F.when(F.contains(url, F.lit("://")), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) columns, null where none fits."""
    rule = verdict = None
    for text, result in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, _, start = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit("/" + start))
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, result) if verdict is None else verdict.when(fits, result)
    empty = F.lit(None).cast("string")
    return (rule, verdict) if rule is not None else (empty, empty)


def counted(texts: Iterable[bytes], order: int) -> dict[bytes, dict[int, int]]:
    """How often each byte follows each context of up to `order` bytes."""
    seen: dict[bytes, dict[int, int]] = {}
    for t in texts:
        t = b"\x02" + t + b"\x03"
        for i in range(1, len(t)):
            for n in range(min(order, i) + 1):
                counts = seen.setdefault(t[i - n : i], {})
                counts[t[i]] = counts.get(t[i], 0) + 1
    return seen


class MarkovModel:
    """Byte model of variable order with Witten-Bell back-off."""

    def __init__(self, texts: Iterable[bytes] = (), order: int = 5, least: int = 2):
        self.order, self.least = order, least
        self.table = {c: (v, sum(v.values()), len(v)) for c, v in counted(texts, order).items() if not c or sum(v.values()) >= least}

    def log_likelihood(self, text: bytes, own: bool = False) -> float:
        """Natural log of the probability of the text and its end; if `own`, as without its own counts."""
        t, total, table = b"\x02" + text + b"\x03", 0.0, self.table
        mine = counted([text], self.order) if own else {}
        for i in range(1, len(t)):
            p, c = 1 / 256, t[i]
            for n in range(min(self.order, i) + 1):
                context = t[i - n : i]
                found = table.get(context)
                if found is None:
                    break
                counts, every, kinds = found
                times = counts.get(c, 0)
                if own:
                    less = mine[context]
                    times, every, kinds = times - less[c], every - sum(less.values()), kinds - sum(counts[k] == v for k, v in less.items())
                    if every < (self.least if context else 1):
                        break
                p = (times + kinds * p) / (every + kinds)
            total += math.log(p)
        return total


@dataclass
class UrlModel:
    accepted: MarkovModel | None = None
    rejected: MarkovModel | None = None
    limit: float = 0.0
    #: (context, bad, total, kinds, nexts) of the contexts that are too many for the two models.
    counts: DataFrame | None = None

    def ratio(self, text: bytes, own: bool | None = None) -> float:
        """Log-likelihood difference (rejected less accepted) for each byte; `own`: the kind that has counted the text."""
        if self.counts is not None:
            raise ValueError("contexts are in a table; use filter_urls")
        if self.accepted is None or self.rejected is None:
            return float("-inf")
        return (self.rejected.log_likelihood(text, own is True) - self.accepted.log_likelihood(text, own is False)) / (len(text) + 1)


def limit_of(ratios: list[tuple[float, bool]]) -> float:
    """The limit for (ratio, rejected) pairs of both kinds."""
    ratios = sorted(ratios)
    n_good, n_bad = sum(not r for _, r in ratios), sum(r for _, r in ratios)
    best, below_good, below_bad = (-1.0, 0.0), 0, 0
    for i, (x, r) in enumerate(ratios[:-1]):
        below_good, below_bad = below_good + (not r), below_bad + r
        gain = below_good / n_good + (n_bad - below_bad) / n_bad
        best = max(best, (gain, (x + ratios[i + 1][0]) / 2))
    good, bad = ([x for x, r in ratios if r == kind] for kind in (False, True))
    high, low = good[min(n_good - 1, int(0.999 * n_good))], bad[n_bad // 4]
    return min(best[1], (high + low) / 2) if low > high else best[1]


def limit_over(ratios: DataFrame) -> float | None:
    """`limit_of` over all rows of (ratio, own); None if a kind has none. Equal ratios stay on one side."""
    each = checkpointed(ratios.groupBy("ratio").agg(F.sum((~F.col("own")).cast("long")).alias("good"), F.sum(F.col("own").cast("long")).alias("bad")))
    n = each.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("ratio").alias("top")).first()
    if not n["good"] or not n["bad"]:
        return None
    summed = checkpointed(running_sums(each, "ratio", ["good", "bad"]))
    at = lambda kind, rank: F.min(F.when(F.col(f"run_{kind}") > rank, F.col("ratio")))  # noqa: E731  the value of that rank, from 0
    gain = F.col("run_good") / n["good"] + (n["bad"] - F.col("run_bad")) / n["bad"]
    best = F.max(F.when(F.col("ratio") < n["top"], F.struct(gain.alias("gain"), "ratio"))).alias("best")
    r = summed.agg(best, at("good", min(n["good"] - 1, int(0.999 * n["good"]))).alias("high"), at("bad", n["bad"] // 4).alias("low")).first()
    limit = 0.0
    if r["best"] is not None:
        limit = (r["best"]["ratio"] + each.where(F.col("ratio") > r["best"]["ratio"]).agg(F.min("ratio")).first()[0]) / 2
    return min(limit, (r["high"] + r["low"]) / 2) if r["low"] > r["high"] else limit


def train(sample: list[tuple[bytes, bool]], order: int = 5) -> UrlModel:
    """A model from (url, rejected) pairs; each calibrates the limit as without its own counts."""
    good, bad = [t for t, r in sample if not r], [t for t, r in sample if r]
    if not good or not bad:
        return UrlModel()
    model = UrlModel(MarkovModel(good, order), MarkovModel(bad, order))
    model.limit = limit_of([(model.ratio(t, r), r) for t, r in sample])
    return model


def made_up(host: Column) -> Column:
    """Whether a label of the host holds a hyphen or a digit or is very long."""
    return F.rlike(host, F.lit(f"[^.]-|[0-9]|[^.]{{{LONG_LABEL + 1}}}"))


def context_counts(known: DataFrame, order: int, least: int = 2) -> DataFrame:
    """(context, bad, total, kinds, nexts) over all rows of (t, bad)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, kinds = utf8(batch.column(0)), batch.column(1).to_pylist()
            for a in range(0, len(texts), 2000):
                for kind in (False, True):
                    seen = counted([t for t, r in zip(texts[a : a + 2000], kinds[a : a + 2000], strict=True) if r == kind], order)
                    rows = [(c, k, n) for c, v in seen.items() for k, n in v.items()]
                    if rows:
                        context, following, n = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(rows)), pa.array(context, pa.binary()), pa.array(following, pa.int32()), pa.array(n, pa.int64())], ["bad", "context", "next", "n"])

    each = known.select("t", "bad").mapInArrow(run, "bad boolean, context binary, next int, n long").groupBy("context", "bad", "next").agg(F.sum("n").alias("n"))
    by_context = each.groupBy("context", "bad").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.map_from_entries(F.collect_list(F.struct("next", "n"))).alias("nexts"))
    return by_context.where((F.col("total") >= least) | (F.octet_length("context") == 0))


def _models(rows: Iterable, order: int, least: int = 2) -> list[MarkovModel]:
    """The accepted and the rejected model of (context, bad, total, kinds, nexts)."""
    models = [MarkovModel(order=order, least=least), MarkovModel(order=order, least=least)]
    for context, bad, total, kinds, nexts in rows:
        models[bad].table[bytes(context)] = (nexts, total, kinds)
    return models


def joined_ratios(texts: DataFrame, counts: DataFrame, order: int) -> DataFrame:
    """(t, own, ratio) of distinct (t, own), with the contexts joined from a table."""
    short = [tuple(r) for r in counts.where(F.octet_length("context") <= 1).select("context", "bad", "total", "kinds", "nexts").collect()]

    @F.arrow_udf("array<struct<context:binary,next:int>>")
    def places(values: pa.Array) -> pa.Array:
        made = [[{"context": c, "next": k} for c, v in counted([t], order).items() if len(c) > 1 for k in v] for t in utf8(values)]
        return pa.array(made, pa.list_(pa.struct([("context", pa.binary()), ("next", pa.int32())])))

    @F.arrow_udf("double")
    def ratio(values: pa.Array, own: pa.Array, found: pa.Array) -> pa.Array:
        out, base = [], _models(short, order)
        for t, kind, rows in zip(utf8(values), own.to_pylist(), found.to_pylist(), strict=True):
            tables: tuple[dict, dict] = ({}, {})
            for r in rows:
                if r["bad"] is not None:
                    counts = tables[r["bad"]].setdefault(r["context"], ({}, r["total"], r["kinds"]))[0]
                    if r["n"] is not None:
                        counts[r["next"]] = r["n"]
            models = _models([], order)
            for m, b, mine in zip(models, base, tables, strict=True):
                m.table = b.table | mine
            out.append(UrlModel(*models).ratio(t, kind))
        return pa.array(out, pa.float64())

    rows = texts.select("t", "own", F.explode_outer(places("t")).alias("x")).select("t", "own", "x.*").join(counts, "context", "left")
    found = rows.select("t", "own", F.struct("context", "next", "bad", "total", "kinds", F.try_element_at("nexts", F.col("next")).alias("n")).alias("x"))
    return found.groupBy("t", "own").agg(F.collect_list("x").alias("x")).select("t", "own", ratio("t", "own", "x").alias("ratio"))


def fit(pages: DataFrame, url_col: str = "url", rules=RULES, seeds=SEED_TOKENS, sample_rows: int | None = None, order: int = 5, max_counts: int = 500_000) -> UrlModel:
    """A model from all distinct urls; all those that no rule decides calibrate its limit, or at most
    `sample_rows` of each kind where a caller wants fewer."""
    urls = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).cast("string").alias("t")).distinct()
    urls = urls.select("t", host_of(F.col("t")).alias("h"), path_of(F.col("t")).alias("p")).where("h <> ''")
    seeded = F.lit(False)
    for x in seeds:
        seeded = seeded | F.contains(F.col("h"), F.lit(x))
    verdict = rule_of(F.col("h"), F.col("p"), rules)[1]
    bad = F.when(verdict.isNotNull(), verdict == "block").when(seeded, True).when(~made_up(F.col("h")), False)
    known = urls.select("t", bad.alias("bad"), verdict.isNull().alias("open")).where("bad is not null")
    known = checkpointed(known.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t"))  # by number: few bytes, much work
    kinds = [known.where(F.col("open") & (F.col("bad") == kind)) for kind in (False, True)]
    if sample_rows is not None:
        kinds = [rows.orderBy(F.xxhash64("t"), "t").limit(sample_rows) for rows in kinds]
    if any(rows.isEmpty() for rows in kinds):
        return UrlModel()
    held = kinds[0].unionByName(kinds[1]).select("t", F.col("bad").alias("own"))
    counts = checkpointed(context_counts(known, order))
    if counts.agg(F.sum("kinds").alias("n")).first()["n"] <= max_counts:
        model = UrlModel(*_models((tuple(r) for r in counts.select("context", "bad", "total", "kinds", "nexts").collect()), order))

        @F.arrow_udf("double")
        def judged(texts: pa.Array, own: pa.Array) -> pa.Array:
            return pa.array([model.ratio(t, k) for t, k in zip(utf8(texts), own.to_pylist(), strict=True)], pa.float64())

        model.limit = limit_over(held.select("own", judged("t", "own").alias("ratio")))
        return model
    return UrlModel(MarkovModel(order=order), MarkovModel(order=order), limit_over(joined_ratios(held, counts, order)), counts)


def filter_urls(pages: DataFrame, model: UrlModel, url_col: str = "url", rules=RULES) -> DataFrame:
    """`pages` with host, path, rule, verdict and ratio (null where a rule decides)."""
    memo: dict[bytes, float] = {}

    judge = model.ratio if model.counts is None else None

    @F.arrow_udf("double")
    def ratio(values: pa.Array) -> pa.Array:
        out = []
        for t in utf8(values):
            if t is None:
                out.append(None)
                continue
            if (r := memo.get(t)) is None:
                if len(memo) > 100_000:
                    memo.clear()
                memo[t] = r = judge(t)
            out.append(r)
        return pa.array(out, pa.float64())

    url = F.col("_row").getField(url_col).cast("string")
    step = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("_row"))  # apart from the columns made here
    step = step.withColumn("_host", host_of(url)).withColumn("_path", path_of(url))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    step = step.withColumn("_rule", rule).withColumn("_verdict", verdict).withColumn("_t", F.when(F.col("_rule").isNull(), F.coalesce(url, F.lit(""))))
    if model.counts is None:
        step = step.withColumn("_ratio", ratio(F.col("_t")))
    else:
        texts = step.where(F.col("_t").isNotNull()).select(F.col("_t").alias("t"), F.lit(None).cast("boolean").alias("own")).distinct()
        ratios = joined_ratios(texts, model.counts, model.accepted.order)
        step = step.join(ratios.select(F.col("t").alias("_t"), F.col("ratio").alias("_ratio")), "_t", "left")
    judged = F.coalesce(F.col("_verdict"), F.when(F.coalesce(F.col("_ratio") > F.lit(model.limit), F.lit(False)), "block").otherwise("allow"))
    made = {"host": F.col("_host"), "path": F.col("_path"), "rule": F.col("_rule"), "verdict": judged, "ratio": F.col("_ratio")}
    return step.select(*[F.col("_row").getField(c).alias(c) for c in pages.columns if c not in made], *[v.alias(k) for k, v in made.items()])
