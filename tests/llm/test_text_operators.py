"""Each operator against a plain version of its definition, and on odd inputs."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline
from lathe.llm import decontaminate as d8
from lathe.llm import html_extract as d5
from lathe.llm import langid as d9
from lathe.llm import line_frequency as d10
from lathe.llm import ngram_join as d2
from lathe.llm import packing as d4
from lathe.llm import quality_fm as d7
from lathe.llm import queries as Q
from lathe.llm import resharding as d6
from lathe.llm import toxicity as d1
from lathe.llm import url_filter as d3
from lathe.llm.textops import class_sample

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType())])

ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, "one", "en", None), (5, "one", "en", "b"), (None, "no id here", "en", "b"),
    (7, "word " * 3000, "de", "b"), (8, "x" * 5000, None, None), (9, "same row", "en", "a"), (9, "same row", "en", "a"), (10, "Ünïcödé — “text” ​日本語 😀", "fr", "c"), (11, "12 34 $$ ##", "es", "c"),
]


def frame(spark, rows):
    """Rows with columns whose names clash with what operators make."""
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("mine") for c in ("score", "hits", "size", "label", "_text", "host", "n_words")})


def texts_of(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


# 1, 7: scores
def test_toxicity_learns_words_and_beginnings():
    rng = np.random.default_rng(0)
    plain = [w + x for w in ("lor", "ips", "dol", "sit") for x in ("a", "em", "or", "um", "is")]
    sample = []
    for i in range(600):
        words = list(rng.choice(plain, 40))
        toxic = i % 4 == 0
        if toxic:
            words[5] = f"grulf{rng.choice(['a', 'en', 'ox', 'us', 'it'])}" if i % 8 else "idiot"
        sample.append((" ".join(words).encode(), int(toxic)))
    m = d1.train(sample, {0: 450, 1: 150})
    got = m.scores([b"lora ipsem grulfzz sita", b"lora ipsem dolor sita", b"you idiot", None, b""])
    assert got[0] > 0.5 and got[2] > 0.5 and got[1] < 0.5 and got[3] < 0.5 and got[3] == got[4]


def test_label_model_discounts_correlated_voters():
    rng = np.random.default_rng(1)
    y = rng.random(2000) < 0.3
    a = (rng.random(2000) < np.where(y, 0.7, 0.05)).astype(float)
    b = (rng.random(2000) < np.where(y, 0.6, 0.05)).astype(float)
    m = d1.fit_label_model(np.column_stack([a, a, a, b]), np.where(y, 0.9, 0.1), np.ones(2000))
    assert m.weights[0] < 0.5 < m.weights[3]


def test_toxicity_is_learnt_from_votes(spark):
    """The classifier's labels are the label model's, not the given ones, and so are its predictions; recall holds."""
    sf = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null").join(texts_of(spark, sf), "doc_id").select("doc_id", "text", "toxic").orderBy("doc_id").collect()
    held = lambda r: zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
    sample = [(r["text"].encode() if r["text"] is not None else None, r["toxic"]) for r in rows if not held(r)]
    tests = [r for r in rows if held(r)]
    texts, given = [r["text"].encode() if r["text"] is not None else None for r in tests], np.array([r["toxic"] for r in tests])
    counts = {c: sum(y == c for _, y in sample) for c in (0, 1)}
    weak, gold = d1.train(sample, counts), d1.train(sample, counts, weak=False)
    assert ((weak.posterior > 0.5) != (weak.given == 1)).sum() >= 20
    got, other = weak.scores(texts) >= 0.5, gold.scores(texts) >= 0.5
    assert (got != other).sum() >= 1
    assert got[given == 1].mean() >= 0.8 and got[given == 0].mean() <= 0.01


def test_a_label_model_depends_on_votes_alone():
    """Voters of known rates, no labels: the rates are found, and that one repeats another."""
    rng = np.random.default_rng(5)
    y = rng.random(6000) < 0.3
    fired = np.column_stack([rng.random(6000) < np.where(y, r, 0.03) for r in (0.8, 0.7, 0.6, 0.75)]).astype(float)
    fired = np.column_stack([fired, fired[:, 0]])  # one repeats another
    m = d1.fit_label_model(fired, d1.first_guess(fired, np.ones(6000), 0.3), np.ones(6000), 0.3)
    assert np.abs(m.rates[1] - [0.8, 0.7, 0.6, 0.75, 0.8]).max() < 0.06 and np.abs(m.rates[0] - 0.03).max() < 0.06
    assert 0 in (m.parent[4],) or m.parent[0] == 4
    assert ((m.posterior(fired) > 0.5) == y).mean() > 0.95


def test_kinds_of_a_class_are_all_found():
    """Rare kinds with voters of their own are not taken for the rest beside a frequent one."""
    rng = np.random.default_rng(6)
    kind = rng.choice(5, 6000, p=(0.5, 0.3, 0.08, 0.07, 0.05))  # 0: not of the class
    fired = np.zeros((6000, 40))
    for k in range(1, 5):
        own = slice(10 * k - 10, 10 * k)
        fired[kind == k, own] = rng.random(((kind == k).sum(), 10)) < (0.35 if k == 1 else np.linspace(1, 0.1, 10))
    weight = np.where(kind == 0, 1.8, 0.2)
    share = float(weight[kind > 0].sum() / weight.sum())
    m = d1.fit_kinds(fired, d1.first_guess(fired, weight, share), weight, share)
    got = m.posterior(fired) > 0.5
    assert len(m.kinds) == 4 and not got[kind == 0].any()
    assert all(got[kind == k].mean() > 0.9 for k in range(1, 5))


def test_samples_do_not_depend_on_partitioning(spark):
    docs = spark.createDataFrame([(i % 40, f"text {i}") for i in range(400)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, y int")
    one, many = (class_sample(d, labels, "y", (0, 1), 8) for d in (docs.coalesce(1), docs.repartition(7)))
    assert one == many and len(one[0]) == 32 and one[1] == {0: 20, 1: 20}


def test_scores_with_one_class_or_none():
    assert d1.train([], {}).scores([b"x"]).tolist() == [0.0]
    assert d7.train([(b"x", 1)], {1: 1}).scores([b"x", None]).tolist() == [1.0, 1.0]
    assert d7.train([], {}).scores([None]).tolist() == [0.5]


def test_factorisation_identity():
    rng = np.random.default_rng(3)
    fm = d7.FactorisationMachine(0.3, rng.normal(size=200), rng.normal(size=(200, 4)), 200 - int(d7._FIRST[-1]))
    idx, val = np.array([3, 17, 60, 199]), np.array([1.0, 0.5, 2.0, -1.0])
    pairs = sum(fm.factors[idx[i]] @ fm.factors[idx[j]] * val[i] * val[j] for i in range(4) for j in range(i))
    assert fm.margins([(idx, val)])[0] == pytest.approx(0.3 + fm.linear[idx] @ val + pairs)


@pytest.mark.parametrize("name,limit,label,classes", [("op1_toxicity", 0.5, "toxic", (0.9, 0.6)), ("op7_quality", 0.3, "quality", (0.9, 0.9))])
def test_scoring_queries_on_held_out_rows(spark, name, limit, label, classes):
    sf = "/root/testdata/sf0.01"
    got = Q.OPS[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert spark.read.parquet(f"{sf}/documents.parquet").count() == Q.OPS[name](spark, sf).count()
    assert all(r["predicted"] == int(r["score"] >= limit) and 0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["predicted"] == r[label] for r in held]) >= classes[0]
    rare = int(label == "toxic")  # the recall of the rarer class
    assert np.mean([r["predicted"] == rare for r in held if r[label] == rare]) >= classes[1]


def test_scorers_take_odd_rows(spark):
    df = frame(spark, ODD)
    labels = spark.createDataFrame([(4, 1), (7, 0), (9, 1), (None, 1), (8, None)], "doc_id long, toxic int")
    for op, label in ((d1, "toxic"), (d7, "toxic")):
        m = op.fit(df, labels, label)
        assert df.select(op.score(m, F.col("text")).alias("s")).where("s between 0 and 1").count() == len(ODD)
        assert op.fit(df.limit(0), labels.limit(0), label).scores([b"x"]).shape == (1,)


# 2
def test_near_duplicates_against_brute_force(spark):
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = list(rng.choice(words, int(rng.integers(20, 90))))
        for _ in range(int(rng.integers(1, 9))):
            t = list(base)
            for _ in range(int(rng.integers(0, 4))):
                t[int(rng.integers(len(t)))] = f"new{rng.integers(10**6)}"
            rows.append(" ".join(t))
    rows += ["A b", "a  B", "a b c", "A B C", "", None, "a", "\t"]
    pairs = list(enumerate(rows))
    df = spark.createDataFrame(pairs, "doc_id long, text string").repartition(5)
    for n, num in ((3, 90), (5, 80), (1, 60)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in d2.linked_classes(df, n=n, num=num).collect()}
        assert got == d2.brute_force(pairs, n, num)


def test_a_chain_links_across_its_middle(spark):
    """Neighbours in a chain link, its ends don't; all are one component."""
    base = [f"w{i}" for i in range(100)]
    rows = []
    for k in range(12):
        t = list(base)
        for j in range(k):
            t[j * 8] = f"x{j}"
        rows.append((k, " ".join(t)))
    got = {r["doc_id"]: r["component_id"] for r in d2.linked_classes(spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=90).collect()}
    assert got == {k: c for k, (_, c) in d2.brute_force(rows, 3, 90).items()}


def test_near_duplicates_take_odd_rows(spark):
    df = frame(spark, ODD)
    got = d2.linked_classes(df, n=3, num=90).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["component_id"] == 4 and by[1]["n_shingles"] == 0 and by[7]["n_shingles"] == 1
    kept = d2.keep_one_of_each(df, n=3, num=90)
    assert kept.columns == df.columns
    ids = sorted((r["doc_id"] or -1) for r in kept.collect())
    assert ids == [-1, 1, 2, 3, 4, 7, 8, 9, 10, 11]
    assert d2.linked_classes(df.limit(0)).count() == 0


def test_each_pair_is_verified_once_and_lone_ngrams_give_no_postings(spark):
    """Postings shuffled are at most twice those that exact counts would leave; no pair comes in both orders."""
    docs = texts_of(spark, "/root/testdata/sf0.01")
    nodes, postings = d2.index(docs, "doc_id", "text", 3, 90, 100)
    sets = [set(d2.gram_set(t.encode(), 3).tolist()) for t in {r["text"] for r in docs.collect() if r["text"]}]
    held = {}
    for x in sets:
        for g in x:
            held[g] = held.get(g, 0) + 1
    exact = sum(held[g] > 1 for x in sets for g in sorted(x, key=lambda g: (held[g], g))[: len(x) - -(-90 * len(x) // 100) + 1])
    assert exact <= postings.count() <= 2 * exact
    shared, hot, pairs = d2.star_pairs(postings, 90, 100)
    rows = [(r["a"], r["b"]) for r in pairs.collect()]
    assert rows and len({tuple(sorted(p)) for p in rows}) == len(rows)
    label = d2.components(d2.verified(pairs, nodes, docs, "doc_id", "text", 3, 90, 100))
    more = {tuple(sorted((r["a"], r["b"]))) for r in d2.residual_pairs(shared, hot, label, pairs, 90, 100).collect()}
    assert not more & {tuple(sorted(p)) for p in rows}


def test_packed_numbers():
    for x in ([], [0], [1, 2**63], list(range(0, 70000, 7))):
        assert d2.unpacked(d2.packed(np.array(x, np.uint64))).tolist() == x and d2.climbed(d2.steps(np.array(x, np.uint64))).tolist() == x


def test_components_of_paths(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r["node"]: r["label"] for r in d2.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}


# 3
def test_url_parts_and_rules(spark):
    cases = {
        "http://A.Example.NET/en/1?q#f": ("a.example.net", "/en/1", "example.net/en/", "allow"),
        "https://x.net": ("x.net", "", None, None),
        "https://x.net/": ("x.net", "/", "net/", "block"),
        "ftp://example.com/de/x": ("example.com", "/de/x", "example.com/de/", "block"),
        "http://notexample.com/de/x": ("notexample.com", "/de/x", None, None),
        "http://a.org/fr/": ("a.org", "/fr/", "org/fr/", "allow"),
        "http://a.org?x=http://b.net/": ("a.org", "", None, None),
        "no scheme": ("", "", None, None),
        None: ("", "", None, None),
    }
    df = spark.createDataFrame([(i, u) for i, u in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("mine"))
    got = {r["url"]: r for r in d3.filter_urls(df, d3.UrlModel()).collect()}
    for url, (host, path, rule, verdict) in cases.items():
        r = got[url]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict or "allow")


def test_url_model_tells_kinds_apart(spark):
    good = [f"blog.the{x}{y}.example.com/en/0" for x in "abcdefgh" for y in ("ran", "tion", "ble", "sh")]
    bad = [f"www.casino-{x}{y}.example.com/en/0" for x in "abcdefgh" for y in ("win", "bet", "pay", "spin")]
    m = d3.train([(t.encode(), r) for t, r in sorted([(g, False) for g in good] + [(b, True) for b in bad])])
    assert m.ratio(b"casino-zwin.example.com/en/0") > m.limit > m.ratio(b"blog.thezran.example.com/en/0")
    p = d3.MarkovModel([b"ab", b"ab", b"ac"])
    total = sum(np.exp(p.log_likelihood(bytes([c]))) for c in range(256))
    assert 0 < total <= 1 + 1e-9
    assert d3.fit(spark.createDataFrame([], "page_id long, url string")).ratio(b"x") == float("-inf")


def test_url_models_count_all_urls(spark):
    """Beyond the calibrating sample, each url counts; contexts in a table give the same ratios."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))  # noqa: E731  digits are one
    urls = [f"http://www.{word(i)}.example.com/{'q' if i == 7 else 'en'}/{word(i * 7)}" for i in range(300)] + [f"http://casino{word(i)}.example.com/win/{word(i * 3)}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate([*urls, None, "no url"])), "page_id long, url string").repartition(3)
    m, joined = d3.fit(df, sample_rows=20), d3.fit(df, sample_rows=20, max_counts=0)
    kinds = lambda n: [(u.encode(), "casino" in u) for u in urls[:n]]
    for model, kind in ((m.accepted, False), (m.rejected, True)):
        assert model.table == d3.MarkovModel([t for t, r in kinds(500) if r == kind]).table
    assert joined.counts is not None and joined.limit == pytest.approx(m.limit)
    got, want = ({r["page_id"]: (r["verdict"], r["ratio"]) for r in d3.filter_urls(df, x).collect()} for x in (joined, m))
    assert len(got) == 502 and {k: v for k, (v, _) in got.items()} == {k: v for k, (v, _) in want.items()}
    for k, (_, r) in want.items():
        assert got[k][1] == (r if r is None else pytest.approx(r))
    left_out = d3.MarkovModel([t for t, r in kinds(500) if not r][1:])
    assert m.accepted.log_likelihood(kinds(1)[0][0], own=True) == pytest.approx(left_out.log_likelihood(kinds(1)[0][0]))


def test_hosts_without_a_seed_token_are_blocked(spark):
    """With seed tokens left out one by one, and for hosts that hold none, the models still find rejected hosts."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("page_id", "url")
    made_up = lambda h: re.search(r"-", h)
    for seeds in (d3.SEED_TOKENS, tuple(x for x in d3.SEED_TOKENS if x != "pills")):
        rows = [r for r in d3.filter_urls(pages, d3.fit(pages, seeds=seeds)).collect() if r["rule"] is None and r["host"]]
        unseeded = [r for r in rows if not any(x in r["host"] for x in seeds)]
        bad, good = [r for r in unseeded if made_up(r["host"])], [r for r in unseeded if not made_up(r["host"])]
        assert len({r["host"] for r in bad}) >= 2 + (seeds != d3.SEED_TOKENS)
        assert np.mean([r["verdict"] == "block" for r in bad]) >= 0.9 and np.mean([r["verdict"] == "allow" for r in good]) >= 0.99


def test_urls_are_judged_whole(spark):
    """Query and fragment count, a null url is the empty string, and one without a scheme is judged, too."""
    word = lambda k: "".join(chr(97 + int(c)) for c in str(k))
    urls = [f"http://{word(i)}.example.com/{word(i * 7)}" for i in range(300)] + [f"http://casino{word(i)}.example.com/{word(i * 3)}?win=bonus&xyz=jackpot" for i in range(200)]
    odd = ["http://qqq.example.com/aa?win=bonus&xyz=jackpot", "http://qqq.example.com/aa", "win=bonus&xyz=jackpot?win=bonus&xyz=jackpot", None]
    df = spark.createDataFrame(list(enumerate(urls + odd)), "page_id long, url string").withColumn("_verdict", F.lit("mine"))
    m = d3.fit(df)
    got = {r["page_id"]: r for r in d3.filter_urls(df, m).collect()}
    assert got[500]["ratio"] > got[501]["ratio"] + 0.5 and got[502]["verdict"] == "block" and got[501]["verdict"] == "allow" and got[0]["_verdict"] == "mine"
    assert got[503]["ratio"] == pytest.approx(m.ratio(b"")) and got[503]["verdict"] == ("block" if m.ratio(b"") > m.limit else "allow")


def test_url_query_covers_all_pages(spark):
    got = Q.OPS["op3_url_filter"](spark, "/root/testdata/sf0.01").collect()
    assert len(got) == 250
    for r in got:
        if re.search(r"casino|pills|spam", r["host"]) and r["rule"] is None:
            assert r["verdict"] == "block"


# 4
def check_packing(rows, ids_by_doc, tokens=2048, segments=256):
    by_sequence, by_doc = {}, {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_doc.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= tokens and len(pieces) <= segments
        padding += 0 if at & (at - 1) == 0 else tokens - at
    for doc, ids in ids_by_doc.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    return padding


def test_packing_against_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_file())
    want = {r["doc_id"]: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in texts_of(spark).collect()}
    assert check_packing(Q.OPS["op4_packing"](spark, SF).collect(), want) == 0


def test_odd_texts_have_the_tokenizers_ids():
    enc = d4.encoder(Q.tokenizer_file())
    odd = [t for _, t, *_ in ODD if t] + ["It's we'LL 'S ''ve", "ΑΣ İ ŉ ẞß É é", "<|endoftext|> a<|startoftext|>b", "x y\x1cz\x00q", "ǅ ٣ ½ ² 1234", "a_b--c ÷×", " ".join(["don't"] * 40)]
    assert enc.ids_of([t.encode() for t in odd]) == [enc._whole(t.encode()) for t in odd]


def test_ids_are_the_tokenizers_when_stretches_are_forgotten():
    from tokenizers import Tokenizer

    whole, rng = Tokenizer.from_file(Q.tokenizer_file()), np.random.default_rng(3)
    words = ["don't", "a1b", "\u00e9t\u00e9", "\u0130x", "\u65e5\u672c", "<|endoftext|>", "x" * 300, *("".join(rng.choice(list("abcde-7"), 6)) for _ in range(400))]
    texts = ["", "  ", "\n\n", *(" ".join(rng.choice(words, 60)) for _ in range(60))]
    small = d4._Encoder(Q.tokenizer_file(), size=50)
    for _ in range(3):
        for i in range(0, len(texts), 7):
            got = small.ids_of([x.encode() for x in texts[i : i + 7]])
            assert [np.frombuffer(g, "<u4").tolist() for g in got] == [whole.encode(x, add_special_tokens=False).ids for x in texts[i : i + 7]]


def test_limits_hold_for_instruction_data(spark):
    df = spark.createDataFrame([(i, "question " * (i % 7), "answer " * (1 + i % 40)) for i in range(300)] + [(300, None, None)], "doc_id long, prompt string, text string").coalesce(1)
    lim = d4.Limits(tokens=128, segments=4, loss_tokens=96, buffer=32)
    rows = d4.pack(df, Q.tokenizer_file(), prompt_col="prompt", limits=lim, with_ids=True).collect()
    per = {}
    for r in rows:
        t, s, l = per.get(r["sequence_id"], (0, 0, 0))
        per[r["sequence_id"]] = (t + r["length"], s + 1, l + r["loss_tokens"])
        assert len(r["ids"]) == r["length"]
    assert all(t <= 128 and s <= 4 and l <= 96 for t, s, l in per.values())
    total = {}
    for r in rows:
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    assert all(total[r["doc_id"]] == r["doc_tokens"] for r in rows) and len(total) == 301


def test_the_querys_limits_bind_and_the_dot_product_beats_first_fit(spark):
    """Segments and loss-bearing tokens run out in some sequences; choosing by dot product needs fewer."""
    enc = d4.encoder(Q.tokenizer_file())
    ids = enc.ids_of([t.encode() if t else t for t in (r["text"] for r in texts_of(spark, "/root/testdata/sf0.01").orderBy("doc_id").collect())])
    made = {}
    for choose in ("dot", "first"):
        p, bins = d4.Packer(Q.PACKED, choose), []
        for i, x in enumerate(ids):
            bins += p.add(d4.Piece(i, x + b"\1\0\0\0", 0, int((len(x) // 4 + 1) * Q.PROMPT_SHARE), len(x) // 4 + 1))
        bins += p.flush()
        made[choose] = bins
        lengths = [sum(x.length for x in b) for b in bins]
        assert sum(lengths) == sum(len(x) // 4 + 1 for x in ids) and all(n == 2048 or n & (n - 1) == 0 for n in lengths)
        assert all(len(b) <= Q.PACKED.segments and sum(x.loss() for x in b) <= Q.PACKED.loss_tokens for b in bins)
    assert any(len(b) == Q.PACKED.segments for b in made["dot"]) and any(sum(x.loss() for x in b) == Q.PACKED.loss_tokens for b in made["dot"])
    assert len(made["dot"]) < len(made["first"])


def test_packing_takes_odd_rows(spark):
    df = frame(spark, ODD)
    assert d4.pack(df, Q.tokenizer_file()).agg(F.sum("length")).first()[0] == sum(len(d4.encoder(Q.tokenizer_file())._whole((t or "").encode())) // 4 + 1 for _, t, *_ in ODD)
    assert d4.pack(df.limit(0), Q.tokenizer_file()).count() == 0


# 5
PAGE = """<!doctype html><html><head><title>x</title><style>p{}</style></head><body><header class=site><h2>Site</h2></header><nav><ul><li>menu</ul></nav>
<div class="cookie-notice">We use cookies</div><main><article><h1>Title &amp; more</h1><p>One<br>two <b>bold</b><p>Three&nbsp;x<ul><li>a<li>b</ul><aside>side</aside><div class="ad">buy</div>
<script>var t="</p>";</script><form><input><p>Mail</p></form><blockquote>quote</blockquote><!-- <p>no</p> --></article><section id="comments"><h3>Comments</h3><article class="comment"><p>nice</p></article></section></main>
<div hidden><p>unseen</p></div><footer>&copy; us</footer>"""


def test_main_text():
    assert d5.main_text(d5.Page(PAGE), None) == "Title & more\nOne two bold\nThree x\na\nb\nquote"
    assert d5.main_text(d5.Page(None), None) == "" and d5.main_text(d5.Page("<p"), None) == "<p" and d5.main_text(d5.Page("plain &lt; text"), None) == "plain < text"


def test_layout_classes_and_an_articles_head():
    page = '<body class="has-sidebar"><div class="wrap with-sidebar"><div class="page-header">Site</div><article class="post no-sidebar"><div class="entry-header"><h1>T</h1></div><p>x</p><div class="nav-links">next</div></article></div>'
    assert d5.main_text(d5.Page(page), None) == "T\nx"


def test_constant_slots_are_template(spark):
    page = "<body><div>Welcome to us</div><div class=post><p>text {0} a</p><p>Share this</p></div><p>Imprint</p></body>"
    other = "<body><div>Welcome to us</div><div>Extra</div><div class=post><h2>head {0}</h2><p>text {0} b</p><p>Share this</p></div><p>Imprint</p></body>"
    rows = [(i, f"http://h.example/{i}", (page if i % 3 else other).format(i)) for i in range(40)] + [(99, "http://lonely.example/", page.format(99)), (100, None, None), (101, "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("_wrapper", F.lit(1)).repartition(4)
    for limit in (16 << 20, 0):  # wrappers broadcast, then joined
        got = {r["page_id"]: r["text"] for r in d5.extract(df.drop("_wrapper"), broadcast_bytes=limit).collect()}
        assert got[1] == "text 1 a" and got[3] == "Extra\nhead 3\ntext 3 b"  # a third of the pages have it: no template
        assert got[99] == "Welcome to us\ntext 99 a\nShare this\nImprint" and got[100] == "" and got[101] == ""
    assert d5.extract(df.limit(0)).count() == 0


@pytest.mark.parametrize("tasks", [2, 70])
def test_a_notice_among_many_paragraphs_is_template(spark, tasks):
    """Every page has the notice among 70 paragraphs of its own; 7 of 10 pages have another one."""
    rows = []
    for i in range(210):
        own = [f"<p>text {i} {k}</p>" for k in range(70)]
        rows.append((i, f"http://h.example/{i}", f"<body><article>{''.join(own[:35])}<p>Notice</p>{''.join(own[35:])}{'<p>Often</p>' if i % 10 < 7 else ''}</article>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(tasks)
    for limit in (16 << 20, 0):
        for r in d5.extract(df, broadcast_bytes=limit).collect():
            lines = r["text"].split("\n")
            assert "Notice" not in lines and ("Often" in lines) == (r["page_id"] % 10 < 7) and len(lines) == 70 + (r["page_id"] % 10 < 7)


def test_names_inside_an_article_are_a_prior(spark):
    """What varies in an article is text, whatever its elements are called; what doesn't is template."""
    page = '<body><div class="comments">no {0}</div><article><p>text {0}</p><h2 id="related-work">head {0}</h2><section id="discussion"><p>said {0}</p></section><div class="legal">law {0}</div><span class="share">Share this</span><nav>next {0}</nav></article>'
    rows = [(i, f"http://h.example/{i}", page.format(i)) for i in range(20)] + [(99, "http://lonely.example/", page.format(99))]
    got = {r["page_id"]: r["text"] for r in d5.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[4] == "text 4\nhead 4\nsaid 4\nlaw 4" and got[99] == "text 99\nhead 99\nsaid 99"


def test_slots_tell_content_without_any_name(spark):
    """Without the tags of articles, menus and footers and without class names, the wrappers give the same texts."""
    sf = "/root/testdata/sf0.1"
    pages = spark.read.parquet(f"{sf}/pages.parquet").withColumn("_host", F.lit("mine"))
    docs = {"\n".join(" ".join(x.split()) for x in r["text"].split("\n") if x.strip()) for r in texts_of(spark, sf).collect() if r["text"]}
    bare, named = ({r["page_id"]: r for r in d5.extract(pages, hints=h).collect()} for h in (False, True))
    assert len(bare) == len(named) == 2500 and all(r["_host"] == "mine" for r in bare.values())
    assert sum(bare[k]["text"] == named[k]["text"] for k in bare) >= 0.95 * 2500
    assert sum(r["text"].split("\n", 1)[-1] in docs for r in bare.values()) >= 0.95 * 2500


def test_deep_pages_and_odd_class_names():
    deep = d5.Page("<div>" * 10_000 + "x<nav>menu</nav><p>y" + "</div>" * 10_000)
    assert d5.main_text(deep, None) == "x\ny" and len(deep.nodes) < 100
    g = d5.Gathering()
    g.add("h", deep)
    ((_, w),) = g.wrappers()
    assert d5.Wrapper.load(w.dump()).decide(tuple(deep.nodes), 0.75, 8, w.slots(0.75, 8))
    page = "<article><p>a</p><div class='side-effects'>b</div><div class='notice-board'>c</div><section class='social-history'>d</section><div class='ad'>e</div></article>"
    assert d5.main_text(d5.Page(page), None) == "a\nb\nc\nd"


def test_tree_matching_is_largest():
    tree = lambda *c: ["r", 1, {}, [[k, 1, {}, []] for k in c]]
    size, pairs = d5.Wrapper.match(tree("a", "b", "c", "b"), tree("b", "c", "x", "b"), {})
    assert size == 4 and len(pairs) == 3


def test_extraction_gives_the_articles(spark):
    sf = "/root/testdata/sf0.01"
    docs = {"\n".join(" ".join(x.split()) for x in r["text"].split("\n") if x.strip()) for r in texts_of(spark, sf).collect()}
    got = Q.OPS["op5_html_extraction"](spark, sf).collect()
    assert len(got) == 250 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert sum(r["text"].split("\n", 1)[-1] in docs for r in got) == 250


# 6
def test_moves_are_cheapest():
    moves = d6.minimum_cost_moves({0: 90, 1: 10, 2: 0}, d6.capacities(100, 4))
    stay = sum(b for i, to in moves.items() for j, b in to if i == j)
    assert stay == 25 + 10 and sum(b for to in moves.values() for _, b in to) == 100
    costs = {(0, 0): 5, (0, 1): 1, (1, 0): 2, (1, 1): 9}
    moves = d6.minimum_cost_moves({0: 5, 1: 5}, [5, 5], lambda i, j: costs[i, j])
    assert moves == {0: [(1, 5)], 1: [(0, 5)]}
    with pytest.raises(ValueError):
        d6.minimum_cost_moves({0: 1}, [2])


@pytest.mark.parametrize("seed", range(4))
def test_moves_against_enumeration(seed):
    rng = np.random.default_rng(seed)
    old, new = rng.multinomial(6, [0.5, 0.3, 0.2]), rng.multinomial(6, [1 / 3] * 3)
    cost = rng.integers(0, 9, (3, 3))
    best = 10**9

    def fill(i, left, total):
        nonlocal best
        if i == 3:
            best = min(best, total)
            return
        for a in range(old[i] + 1):
            for b in range(old[i] - a + 1):
                use = (a, b, old[i] - a - b)
                if all(u <= r for u, r in zip(use, left, strict=True)):
                    fill(i + 1, [r - u for u, r in zip(use, left, strict=True)], total + sum(u * c for u, c in zip(use, cost[i], strict=True)))

    fill(0, list(new), 0)
    moves = d6.minimum_cost_moves(dict(enumerate(map(int, old))), list(map(int, new)), lambda i, j: int(cost[i, j]))
    assert sum(b * cost[i, j] for i, to in moves.items() for j, b in to) == best


def test_resharding_query(spark):
    rows = Q.OPS["op6_resharding"](spark, SF).collect()
    want = {r["doc_id"]: r["text"] for r in texts_of(spark).collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(want)
    shards, largest = {}, max(r["size"] for r in rows)
    for r in rows:
        raw = (want[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 16 and r["text_crc32"] == zlib.crc32(raw)
        shards.setdefault(r["shard"], []).append(r)
    mean = sum(r["size"] for r in rows) / 40
    assert set(shards) <= set(range(40))
    old = {}
    for r in rows:
        old[r["old_shard"]] = old.get(r["old_shard"], 0) + r["size"]
    least = sum(max(0, b - (mean if i < 40 else 0)) for i, b in old.items())  # what the fullest shards must give
    assert sum(r["size"] for r in rows if r["shard"] != r["old_shard"]) <= least + 40 * largest
    for part in shards.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
        assert abs(sum(r["size"] for r in part) - mean) <= largest + 1


def test_full_shards_of_unlike_rows_stay(spark):
    """One shard of large rows and one of small ones, both as large as they should be: nothing moves."""
    df = spark.createDataFrame([(i, "t" * 984, 0) for i in range(40)] + [(100 + i, "t" * 84, 1) for i in range(400)], "doc_id long, text string, old int")
    placed, moves = d6.reshard(df, F.col("old"), 2)
    assert placed.where("shard <> old_shard").count() == 0 and moves == {0: [(0, 40_000)], 1: [(1, 40_000)]}


def test_resharding_takes_odd_rows_and_rewrites_files(spark, tmp_path):
    df = frame(spark, ODD)
    placed, _ = d6.reshard(df, F.pmod(F.xxhash64("source"), F.lit(3)), 4)
    assert placed.count() == len(ODD)
    assert d6.reshard(df.limit(0), F.lit(0), 4)[0].count() == 0
    path = str(tmp_path / "old")
    rows = spark.createDataFrame([(i, "t" * (i % 50), 0 if i < 80 else 1) for i in range(120)], "doc_id long, text string, shard int")
    rows.write.partitionBy("shard").parquet(path)
    changed = d6.rewrite_files(path, spark, str(tmp_path / "new"), 3)
    back = spark.read.parquet(str(tmp_path / "new"))
    level = str(tmp_path / "level")
    spark.createDataFrame([(i, "t" * 84, i % 3 if i < 60 else 2) for i in range(80)] + [(100 + i, "t" * 84, 3) for i in range(20)], "doc_id long, text string, shard int").write.partitionBy("shard").parquet(level)
    d6.rewrite_files(level, spark, str(tmp_path / "whole"), 4)
    whole = spark.read.parquet(str(tmp_path / "whole"))
    assert sorted(r["doc_id"] for r in whole.collect()) == [*range(80), *range(100, 120)]
    assert changed == {0, 1, 2} and sorted(map(tuple, back.select("doc_id", "text").collect())) == sorted((i, "t" * (i % 50)) for i in range(120))


# 8
def test_decontamination_against_brute_force(spark):
    rng = np.random.default_rng(2)
    words = list("abcdefgh")
    items = [(str(i), " ".join(rng.choice(words, int(rng.integers(0, 9))))) for i in range(25)] + [("x", None), ("y", "Équipe-é 7"), ("z", "Équipe—é 7")]
    texts = [" ".join(rng.choice(words, int(rng.integers(0, 60)))).upper() for _ in range(60)] + [None, "", "...", "pre ÉQUIPE é 7 post", "équipe É 7", "a" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = d8.brute_force(texts, items, 4)
    for limit in (10**6, 40):  # one block, then several
        got = {r["doc_id"]: r["hits"] for r in d8.find_hits(df, bench, 4, max_windows=limit).collect()}
        for i, (n, hit, mine) in enumerate(want):
            assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"]) == (n, hit, mine)
            assert sum(s["last"] - s["first"] + 1 for s in got[i]["spans"]) == hit


def test_items_without_an_id_and_clashing_columns(spark):
    items = [(None, "one two"), ("a", "two three"), (None, "one two")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    df = spark.createDataFrame([(1, "one two three", "mine", "mine", "mine"), (2, None, "mine", "mine", "mine")], "doc_id long, text string, _hits string, _united string, _row string")
    for limit in (10**6, 4):
        got = {r["doc_id"]: r for r in d8.find_hits(df, bench, 2, max_windows=limit).collect()}
        assert got[1]["hits"]["items"] == ["a", None] and got[1]["hits"]["n_hit"] == 3 and got[2]["_united"] == "mine"
    for action, left in (("remove_document", [2]), ("remove_span", [1, 2])):
        kept = d8.decontaminate(df, bench, action, n=2)
        assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == left and {r["_hits"] for r in kept.collect()} == {"mine"}


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "secret test question")], "item_id int, text string")
    df = frame(spark, [(1, "Before. SECRET, test question! After", None, None), (2, "clean", None, None), (3, None, None, None)])
    got = {r["doc_id"]: r["text"] for r in d8.decontaminate(df, bench, "remove_span").collect()}
    assert got == {1: "Before. ! After", 2: "clean", 3: None}
    kept = d8.decontaminate(df, bench)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    with pytest.raises(ValueError):
        d8.decontaminate(df, bench, "burn")
    assert d8.digest([]) == hashlib.sha256(b"").hexdigest()


# 9
def test_language_query(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.OPS["op9_language"](spark, sf).join(texts_of(spark, sf).select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == 1000 and len(held) > 150
    assert np.mean([r["lang_pred"] == r["lang"] for r in held]) > 0.97
    assert np.mean([r["rejected"] for r in got]) < 0.02


def test_language_of_odd_rows(spark):
    df = frame(spark, ODD)
    m = d9.train([("the quick brown fox and the dog", "en"), ("der schnelle braune fuchs und der hund", "de")] * 30)
    got = [r["r"] for r in df.select("doc_id", d9.predict(m, F.col("text")).alias("r")).collect()]
    assert len(got) == len(ODD)
    for (_, t, *_), r in zip(ODD, got, strict=True):
        assert (r["lang_pred"] == "und") == (not re.search(r"[^\W\d_]", t or "")) and 0 <= r["score"] <= 1
    none = d9.train([])
    assert none.probabilities(["text"]).shape == (1, 1)
    assert df.limit(0).select(d9.predict(none, F.col("text"))).count() == 0


def test_language_training_reads_whole_texts():
    """Words that tell the languages apart stand where 64 evenly spaced words of a text don't."""
    rng = np.random.default_rng(1)
    own = {"aa": ["qibbol", "qazzem", "qoffur"], "bb": ["wurtle", "wimmpa", "woxxen"]}
    skipped = sorted(set(range(640)) - set(np.linspace(0, 639, 64).astype(int).tolist()))
    sample = []
    for i in range(200):
        lang = ("aa", "bb")[i % 2]
        words = list(rng.choice(["lor", "ips", "dol", "sit"], 640))
        for k in skipped:
            words[k] = str(rng.choice(own[lang]))
        sample.append((" ".join(words), lang))
    p = d9.train(sample).probabilities(["qibbol qoffur", "wurtle woxxen"])
    assert p[0, 0] > 0.9 and p[1, 1] > 0.9


def test_subwords():
    grams, sizes = d9.subwords([b"ab", b"c"], 1 << 16)
    assert sizes.tolist() == [3 + 2 + 1, 2 + 1] and len(grams) == 9
    assert (d9.subwords([b"c"], 1 << 16)[0] == grams[6:]).all()


# 10
def plain_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {k + j for at in grams.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_line_measures_against_plain(spark):
    rng = np.random.default_rng(4)
    extra = [(100 + i, "\n".join(" ".join(rng.choice(list("abc#"), 5)) for _ in range(12)), None, "a") for i in range(20)]
    df = frame(spark, ODD + extra)
    got = {}
    for r in d10.line_frequency_rules(df).collect():
        got.setdefault(r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]))
    for i, t, *_ in ODD + extra:
        m = plain_measures(t)
        assert got[i] == (*m, m[0] < 50 or 100 * m[4] > 50 * m[0])
    assert d10.line_frequency_rules(df).count() == len(ODD) + 20 and d10.line_frequency_rules(df.limit(0)).count() == 0


@pytest.mark.parametrize("host", [100, 2_000, 20_000])
def test_a_growing_host_does_not_protect_a_line(spark, host):
    """11 documents that are nothing but a shared line go at every size of the host; 10 stay."""
    shared = " ".join(f"shared{k}" for k in range(60))
    few = " ".join(f"few{k}" for k in range(60))
    own = "concat(repeat(concat('own ', translate(cast(id as string), '0123456789', 'abcdefghij'), ' '), 2), array_join(transform(sequence(1, 60), k -> concat('w', id, 'v', k)), ' '))"
    df = spark.range(host).selectExpr("id as doc_id", f"case when id < 11 then '{shared}' when id < 21 then '{few}' else {own} end as text", "'a' as source")
    assert {r["doc_id"] for r in d10.line_frequency_rules(df).where("not kept").collect()} == set(range(11))


def test_lines_are_hashed_once(spark):
    """The counts and the shares both read one exchange of line hashes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")  # has frequent lines; without any the join falls away
    share = d10.removed_share(docs)
    share.collect()
    plan = share._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "ReusedExchange" in plan and plan.count("Generate explode") == 1


def test_depleted_documents_go(spark):
    letters = lambda k: "".join(chr(97 + int(c)) for c in str(k))  # noqa: E731  digits don't count
    own = lambda i, n: " ".join(f"u{letters(i)}x{letters(k)}" for k in range(n))
    shared = " ".join(f"shared{k}" for k in range(60))
    rows = [(i, f"{shared}\n{own(i, 5)}", "en", "a") for i in range(15)] + [(20 + i, f"{shared} 12.\n{own(i + 20, 80)}", "en", "a") for i in range(3)] + [(40, f"{shared}\n{own(40, 5)}", "en", "b")]
    df = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["kept"] for r in d10.line_frequency_rules(df).collect()}
    assert got == {**{i: False for i in range(15)}, 20: True, 21: True, 22: True, 40: True}
    cut = {r["doc_id"]: r["text"] for r in d10.without_frequent_lines(df).collect()}
    assert cut[3] == own(3, 5) and cut[40] == rows[-1][1]


# pipeline
def test_pipeline_stages(spark):
    docs = texts_of(spark)
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).checkpoint()
        seen[name] = out.count()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "near_duplicates":
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            want = d2.brute_force(rows, 5, 80)
            assert {r["doc_id"] for r in out.collect()} == {i for i, (n, c) in want.items() if c == i}
        if name == "benchmark_decontamination":
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
            hits = d8.brute_force([t for _, t in rows], items)
            assert {r["doc_id"] for r in out.collect()} == {i for (i, _), h in zip(rows, hits, strict=True) if not h[1]}
        docs = out
    assert len(seen) == 5 and all(seen.values())


def test_the_limit_is_of_all_urls(spark):
    """Over all rows it is what the list form finds, and `fit` takes every url that no rule decides."""
    rng = np.random.default_rng(8)
    for n_good, n_bad, apart in ((3000, 700, 1.0), (500, 40, 9.0), (1, 1, 1.0)):
        rows = [(float(x), False) for x in rng.normal(0, 1, n_good)] + [(float(x), True) for x in rng.normal(apart, 1, n_bad)]
        assert d3.limit_over(spark.createDataFrame(rows, "ratio double, own boolean").repartition(3)) == pytest.approx(d3.limit_of(rows), abs=1e-12)
    assert d3.limit_over(spark.createDataFrame([(1.0, False)], "ratio double, own boolean")) is None
    good = [f"http://plain{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}.test/{'uvwxyz'[i % 6]}/{i}" for i in range(4500)]
    bad = [f"http://casino{'abcdefghij'[i % 10]}.test/{'play' * (i % 4)}/{i}" for i in range(300)]
    df = spark.createDataFrame([(u,) for u in good + bad], "url string")
    m = d3.fit(df)
    every = [(m.ratio(u.encode(), kind), kind) for urls, kind in ((good, False), (bad, True)) for u in urls]
    assert m.limit == pytest.approx(d3.limit_of(every), abs=1e-12) and m.limit != d3.fit(df, sample_rows=60).limit


def test_a_sample_of_texts_reaches_the_driver_as_batches_and_stages_give_memory_back(spark, monkeypatch):
    """No rows with texts are collected, as the driver's heap would merge those of every partition; the sample is by id."""
    import corpus_pipeline
    from lathe.llm import textops

    docs = spark.createDataFrame([(i, f"text {i}" if i % 7 else None, "en") for i in range(60)], "doc_id long, text string, lang string").repartition(9)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    collected, given = [], []
    collect = type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda df: collected.append(df.columns) or collect(df))
    rows, counts = textops.class_sample(docs, labels, "quality", (0, 1), 100)
    assert rows == [(f"text {i}" if i % 7 else None, i % 2) for i in range(60)] and counts == {0: 30, 1: 30}
    assert collected and not any("text" in c for c in collected)
    monkeypatch.setattr(corpus_pipeline, "release", given.append)
    corpus_pipeline.language_identification(spark, docs, "")
    assert given == [spark]
