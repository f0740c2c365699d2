"""Operators that SQL can't express against plain versions, planted cases, and odd tables."""

import hashlib
import math
import random
import re
import struct
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm import covered, prose

from foresail.llm import queries as Q

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def spark_hash(*values):
    """Spark's xxhash64 of longs, strings and ints."""
    h = 42
    for v in values:
        b = v.encode() if isinstance(v, str) else struct.pack("<q", v[0]) if isinstance(v, tuple) else struct.pack("<i", v)
        h = xxhash.xxh64(b, seed=h).intdigest()
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text):
    from foresail.llm.fingerprint import ATTEMPTS, BINS

    w = [(spark_hash(x),) for x in re.split(r"[\x20\x09-\x0D]+", text) if x]
    if not w:
        return ""
    hashes = [spark_hash(*w[i : i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [spark_hash(*w)]
    bins = {}
    for h in hashes:
        b = (h + (1 << 63)) >> 57  # the top seven bits of the order of signed numbers
        bins[b] = min(bins.get(b, h), h)
    out = []
    for i in range(BINS):
        if i not in bins:
            tries = [spark_hash(i, t) % BINS for t in range(ATTEMPTS)]
            b = next((x for x in tries if x in bins), None)
            b = min(bins, key=lambda k: (spark_hash(i, k, ATTEMPTS), k)) if b is None else b
        else:
            b = i
        out.append(f"{bins[b] % 256:02x}")
    return "".join(out)


def test_fingerprint_bins(spark):
    """Bins, densification and packing, and likeness as the share of equal digits."""
    from foresail.llm.fingerprint import likeness, with_fingerprint

    r = random.Random(1)
    texts = ["", " \n", "one", "a b c d", "a b c d e", *(prose(r, n) for n in (6, 20, 90, 700)), "ä" * 50, "x " * 3000]
    df = with_fingerprint(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string"), "t", "f")
    got = {x.i: x.f for x in df.collect()}
    assert got == {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    a, b = got[7], got[8]
    same = sum(a[k : k + 2] == b[k : k + 2] for k in range(0, len(a), 2)) / 128
    row = spark.createDataFrame([(a, b)], "a string, b string").select(likeness(F.col("a"), F.col("b")).alias("s")).first()
    assert row.s == pytest.approx(max(0, (same - 1 / 256) / (1 - 1 / 256)))


def test_planted_secrets():
    """Random strings are found, words and identifiers are left alone; the spans are where they were put."""
    from foresail.llm.secret_scan import _vocabulary, find_spans

    enc, r = _vocabulary(Q.RANK_VOCAB, Q.PATTERN), random.Random(3)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hit = 0
    for _ in range(400):
        key = "".join(r.choice(letters) for _ in range(r.randint(24, 48)))
        text = f"{prose(r, 5)} {key} {prose(r, 5)}"
        at = text.index(key)
        hit += (at, 3, at + len(key)) in find_spans(text, enc)
    assert hit >= 392
    words = "the internationalization_of_long_identifiers/and/paths/to/some/file get_user_by_name 2024-01-01_12-30-00 ======================== 550e8400-e29b-41d4-a716-446655440000".split()
    assert all(find_spans(w, enc) == [] for w in words)
    assert not any(find_spans(prose(r, 300), enc) for _ in range(30))


def test_near_duplicates_recall(spark):
    """All links of similarity 0.75 to 0.9 among many pairs, against all pairs; none between others."""
    from foresail.llm.minhash import near_duplicates

    r, texts = random.Random(6), []
    for i in range(150):
        words = prose(r, r.randint(80, 200)).split()
        edits = r.randint(1, 6)
        other = list(words)
        for at in r.sample(range(len(words)), edits):
            other[at] = f"edit{i}"
        texts += [" ".join(words), " ".join(other)]
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    want = {(i, i + 1) for i in range(0, len(texts), 2) if 100 * len(sets[i] & sets[i + 1]) >= 75 * len(sets[i] | sets[i + 1])}
    got = near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text").collect()
    found = {(x.component_id, x.doc_id) for x in got if x.component_id != x.doc_id}
    assert found <= want and len(found) >= 0.99 * len(want) and 40 < len(want) < 150


def test_mixing_rates(spark):
    """Copies are the plain solution's rates, rounded: tilted rates that meet the target, found by bisection over single documents."""
    from foresail.llm.mixing import fill_targets, mix

    r = random.Random(8)
    rows = [(i, r.choice(["a", "a", "b", None]), r.randint(0, 400)) for i in range(600)]
    got = mix(spark.createDataFrame(rows, "id bigint, source string, n bigint"), "id", "source", F.col("n")).collect()
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = fill_targets(list(sizes.items()))
    for s in sizes:
        own = [n for _, x, n in rows if x == s]
        mean, lo, hi = sum(own) / len(own), -50.0, 50.0
        rate = lambda n, lam: 2 / (1 + math.exp(-lam * n / mean))  # noqa: E731, B023
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(n * rate(n, mid) for n in own) < targets[s] else (lo, mid)
        taken = [(x["__size"], x["__copies"]) for x in got if x.source == s]
        assert sum(x["__taken"] for x in got if x.source == s) == pytest.approx(targets[s], abs=1) and all(x["__target"] == pytest.approx(targets[s]) for x in got if x.source == s)
        # systematic rounding: up to any size, copies are the sum of rates but for less than one
        for top in (50, 150, 300, 400):
            assert abs(sum(c for n, c in taken if 0 < n <= top) - sum(rate(n, lo) for n in own if 0 < n <= top)) <= 1.01


def test_toxicity_gradient():
    """The training against a plain dense version."""
    from foresail.llm.toxicity import fit_nnpu

    r = np.random.default_rng(2)
    x_p, x_u, prior = r.random((12, 7)) * (r.random((12, 7)) < 0.6), r.random((40, 7)) * (r.random((40, 7)) < 0.5), 0.3
    x_p[:, 0] += 1
    sparse = lambda x: [[(j, float(v)) for j, v in enumerate(row) if v] for row in x]
    w, b = fit_nnpu(sparse(x_p), sparse(x_u), 7, prior, steps=150)
    v, c, m1, m2 = np.zeros(8), 0, np.zeros(8), np.zeros(8)
    v[7] = math.log(prior / (1 - prior))
    a_p, a_u = (np.c_[x, np.ones(len(x))] for x in (x_p, x_u))
    for t in range(1, 151):
        s_p, s_u = (1 / (1 + np.exp(-a @ v)) for a in (a_p, a_u))
        negative = (-np.log(1 - s_u)).mean() - prior * (-np.log(1 - s_p)).mean()
        grad_negative = a_u.T @ s_u / len(a_u) - prior * a_p.T @ s_p / len(a_p)
        g = -grad_negative if negative < 0 else grad_negative + prior * a_p.T @ (s_p - 1) / len(a_p)
        c += negative < 0
        g[:7] += 1e-3 * v[:7]
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        v = v - 0.05 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(np.r_[w, b], v, atol=1e-6) and c > 0


def test_toxicity_bound_is_on_rows(spark):
    """One id on thousands of rows doesn't take more rows to the driver than the limit."""
    from foresail.llm import toxicity as X

    docs = spark.createDataFrame([(1, f"you moron {i}") for i in range(1500)] + [(i, f"fine text {i}") for i in range(2, 300)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 1), (3, 1, 0), (5, 0, 0)], "doc_id bigint, quality int, toxic int")
    seen = []
    fit = X.fit_nnpu

    def spy(positive, unlabelled, *rest):
        seen.append((len(positive), len(unlabelled)))
        return fit(positive, unlabelled, *rest)

    X.fit_nnpu = spy
    try:
        assert X.train(docs, labels, "doc_id", "text", max_positive=10, max_unlabelled=50)
    finally:
        X.fit_nnpu = fit
    assert seen == [(10, 50)]


def test_long_and_odd_texts(spark):
    """Texts of megabytes, with blanks and without, in scripts without blanks too."""
    from tokenizers import Tokenizer

    from foresail.llm.bpe import TreeEncoder
    from foresail.llm.quality import measure
    from foresail.llm.secret_scan import _vocabulary, find_spans
    from foresail.llm.suffix_dedup import dedup_substrings

    r = random.Random(4)
    t, tree = Tokenizer.from_file(Q.JSON_VOCAB), TreeEncoder(Q.JSON_VOCAB, Q.PATTERN, leaf_chars=2000)
    long = prose(r, 200_000)
    texts = [long, "".join(r.choice("漢字和仮名。、1２") for _ in range(30_000)), "".join(r.choice("कखग ािी।१२") for _ in range(30_000)), "ab'cd''ll 12é—x" * 3000, "　  x" * 5000]
    for x in texts:
        assert tree.encode(x) == t.encode(x, add_special_tokens=False).ids
    assert measure(long)[0] == 200_000 and find_spans(long, _vocabulary(Q.RANK_VOCAB, Q.PATTERN)) == []
    part = long[: 1 << 20]
    data = [part.encode(), (part[5000:9000] + "!").encode()]
    got = {x.doc_id: x.n_removed for x in dedup_substrings(spark.createDataFrame([(i, d.decode()) for i, d in enumerate(data)], "doc_id int, text string"), "doc_id", "text").collect()}
    assert got == {0: 4000, 1: 4000}


CLASH = ", k string, n bigint, id int, keys string, h int, runs string, t string, node int, html_ string, __size int, __k string, y int, score double"
EXTRA = ("k", 1, 2, "x", 3, "r", "t", 4, "h", 5, "kk", 6, 0.5)


def test_clashing_columns(spark, tmp_path):
    """Extra columns with the operators' own names change nothing, in any table."""
    r = random.Random(9)
    docs = [(i, prose(r, 70) + (" moron" if i % 7 == 0 else ""), "en", r.choice(["a", "b"]), 0) for i in range(40)]
    tables = {
        "documents": (docs, DOCS), "labels": ([(i, 1, int(i % 7 == 0)) for i in range(40)], "doc_id bigint, quality int, toxic int"),
        "pages": ([(i, f"http://a.example/{i}", f"<article><p>{prose(r, 9)}</p></article>") for i in range(8)], "page_id bigint, url string, html string"),
        "conversations": ([(1, 0, "user", "a"), (1, 1, "assistant", "b"), (None, 0, "user", None)], "conv_id bigint, turn bigint, role string, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"a/{name}.parquet"))
        spark.createDataFrame([(*x, *EXTRA) for x in rows], schema + CLASH).write.parquet(str(tmp_path / f"b/{name}.parquet"))
    for name, query in Q.queries().items():
        a, b = (query(spark, str(tmp_path / x)) for x in "ab")
        assert a.columns == b.columns, name
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect())), name


def test_pipeline_stages(spark, tmp_path):
    """Every stage against a plain version on what the one before it kept; nulls, repeated rows and ids, copies and secrets among the documents."""
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    from foresail.llm.secret_scan import _vocabulary, find_spans

    r = random.Random(12)
    base = [prose(r, r.randint(60, 140)) for _ in range(30)]
    texts = [None, "", "short one", *base, base[0], base[1] + " and more", base[2], 'see token = "abcdef0123456789abcd" ' + prose(r, 60)]
    rows = [(i, t, "en", ["a", "b", None][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[10], (None, base[5] + " tail", "en", "a", 0), (7, prose(r, 80), "de", "b", 0)]
    rows += [(500 + i, "few words here", "en", "bad", 0) for i in range(30)] + [(600, prose(r, 90), "en", "bad", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    key = lambda d: sorted(map(str, (tuple(x) for x in d)))

    # quality: own rules, then hosts by the shrunken rate
    def fails(t):
        w = (t or "").split()
        c = Counter(zip(w, w[1:], w[2:]))
        rep = {j for i, g in enumerate(zip(w, w[1:], w[2:])) if c[g] > 1 for j in (i, i + 1, i + 2)}
        return len(w) < 50 or 100 * len(rep) > 50 * len(w)

    hosts = {h: [fails(x[1]) for x in rows if x[3] == h] for h in {x[3] for x in rows} - {None}}
    p = [sum(f) / len(f) for f in hosts.values()]
    m = sum(p) / len(p)
    between = max(sum((x - m) ** 2 for x in p) / len(p) - m * (1 - m) * sum(1 / len(f) for f in hosts.values()) / len(p), 1e-6)
    s = max(m * (1 - m) / between - 1, 1.0)
    bad = {h for h, f in hosts.items() if (sum(f) + m * s) / (len(f) + s) > 0.5}
    kept = [x for x in rows if not fails(x[1]) and x[3] not in bad]
    one = P.quality(spark, docs, "").collect()
    assert bad == {"bad"} and key(one) == key(kept)

    # near copies: components of distinct documents, the smallest (id, null first) stays, once
    def same(a, b):
        a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x.split() for x in (a, b)))
        return 100 * len(a & b) >= 75 * len(a | b)

    left = sorted(set((x[0], x[1]) for x in kept), key=lambda x: (x[0] is not None, x[0] or 0))
    stay = []
    for i, x in enumerate(left):
        group, grown = {i}, True
        while grown:
            more = {j for j in range(len(left)) if j not in group and any(same(left[j][1], left[g][1]) for g in group)}
            group, grown = group | more, bool(more)
        if min(group) == i:
            stay.append(x)
    two = P.near_dedup(spark, spark.createDataFrame(one, DOCS), "").collect()
    assert key((x.doc_id, x.text) for x in two) == key(stay) and len(two) == len(stay) < len(kept)

    # secrets: spans of the scan go, the rest of each text stays
    enc = _vocabulary(Q.RANK_VOCAB, Q.PATTERN)
    three = P.secrets(spark, spark.createDataFrame(two, DOCS), "").collect()
    gone = 0
    for x in two:
        now = next(y for y in three if (y.doc_id, y.source) == (x.doc_id, x.source) and y.text[-40:] == x.text[-40:])
        spans = find_spans(x.text, enc)
        gone += bool(spans)
        parts = now.text.split("[SECRET]")
        assert now.n_chars == len(now.text) and (spans or now.text == x.text) and all(q in x.text for q in parts) and "abcdef0123456789" not in now.text
    assert len(three) == len(two) and gone == 1

    # mixing: each document at most twice and whole, sources near their targets
    from foresail.llm.mixing import fill_targets

    four = P.mixture(spark, spark.createDataFrame(three, DOCS), "").collect()
    sizes, took, most = Counter(), Counter(), 0
    for x in three:
        sizes[x.source] += len(x.text.split())
        most = max(most, len(x.text.split()))
    for x in four:
        took[x.source] += len(x.text.split())
    copies = Counter((x.doc_id, x.text) for x in four)
    assert set(copies) <= {(x.doc_id, x.text) for x in three} and max(copies.values()) <= 2
    assert all(abs(took[h] - t) <= most for h, t in fill_targets(list(sizes.items())).items())

    # tokens: the tokenizers library's
    t = Tokenizer.from_file(Q.JSON_VOCAB)
    five = P.tokens(spark, spark.createDataFrame(four, DOCS), "").collect()
    assert key((x.doc_id, x.n_tokens, list(x.ids)) for x in five) == key((x.doc_id, len(i), i) for x in four for i in [t.encode(x.text, add_special_tokens=False).ids])

    # and all of it together, over the written table
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert key((x.doc_id, x.n_tokens, list(x.ids)) for x in P.run(spark, str(tmp_path)).collect()) == key((x.doc_id, x.n_tokens, list(x.ids)) for x in five)


def test_pipeline_empty(spark, tmp_path):
    import corpus_pipeline as P

    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids"]
    assert P.run(spark, str(tmp_path)).count() == 0


def test_chat_deep_tree(spark):
    """A branching tree of depth 1,000 and a tree named null beside the null one, against a plain walk."""
    from foresail.llm.chat import escape, format_conversations, turn  # noqa: F401

    r, rows = random.Random(13), [("deep", 0, None, 0.0, "user", "t0")]
    for i in range(1, 1000):
        rows.append(("deep", i, i - 1, r.random(), "assistant" if i % 2 else "user", f"t{i}"))
    rows += [("deep", 5000 + i, r.randint(0, 998), r.random() - 0.5, "assistant", f"side{i}") for i in range(40)]
    rows += [("null", 1, None, 0.0, "user", "named"), (None, 1, None, 0.0, "user", "none"), (None, 2, 1, 0.0, "assistant", "<answer>")]
    got = {(x.tree, x["rank"]): x.formatted for x in format_conversations(spark.createDataFrame(rows, "tree string, node bigint, parent bigint, score double, role string, text string"), best=3).collect()}
    node = {x[1]: x for x in rows if x[0] == "deep"}
    inner = {x[2] for x in node.values()}
    ways = []
    for leaf in set(node) - inner:
        path, at = [], leaf
        while at is not None:
            path.insert(0, node[at])
            at = node[at][2]
        ways.append((-sum(x[3] for x in path), -len(path), leaf, "".join(f"<turn {x[4]}>{x[5]}</turn>\n" for x in path)))
    assert [got["deep", k] for k in (1, 2, 3)] == [w[3] for w in sorted(ways)[:3]]
    assert got["null", 1] == "<turn user>named</turn>\n" and got[None, 1].endswith("\\lanswer\\g</turn>\n") and len(got) == 5


def test_empty_conversations(spark, tmp_path):
    spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert [x.conv_id for x in Q.op2_chat_format(spark, str(tmp_path)).collect()] == [-7]


def test_covered_counts():
    assert covered([b"abcab", b"ab"], 2)[0].tolist() == [True, True, False, True, True]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
