"""Each operator against a brute-force version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresail.llm import queries as Q

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n bigint, k string, id int, keys string, whole int"


def prose(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(3)
    base = prose(r, 200)
    texts = [None, "", " \n ", "one two", base, base, base.upper(), base + " tail", prose(r, 30) + " " + base[:600], prose(r, 5000), "x" * 3000, prose(r, 80), base[:500] + " | " + base[700:]]
    texts += [prose(r, 60) + ' token = "abcdef0123456789abcd" end', "AKIA" + "Q" * 16, "a\n" * 40, "ü" * 900, prose(r, 300)]
    out = [(i, t, "en", ["a", "b", None][i % 3], len(t or ""), 1, "k", 2, "x", 3) for i, t in enumerate(texts)]
    return [*out, out[5], (None, prose(r, 70), None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def covered(data, length):
    """By text, which bytes a string of that length covers that starts in two places or more."""
    seen = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                m[i : i + length] = True
        out.append(m)
    return out


def test_suffix_dedup(docs, rows):
    from foresail.llm.suffix_dedup import SHORT, dedup_substrings

    data = [(r[1] or "").encode() for r in rows]
    want = []
    for r, b, m, brief in zip(rows, data, covered(data, 400), covered(data, SHORT), strict=True):
        spans = int((np.diff(m.astype(int), prepend=0) == 1).sum())
        want.append((r[0], len(b), int(m.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~m])).hexdigest(), int(brief.sum())))
    got = [(*tuple(x)[:5], x.n_repeated) for x in dedup_substrings(docs, "doc_id", "text").collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(w[5] > w[2] for w in want)


@pytest.mark.parametrize("limits", [{}, {"in_memory": 2, "queue_bytes": 32}])
def test_induced_sorter(limits):
    """Against a count of all strings; with small limits names are sorted by recursion and queues go to disk."""
    from foresail.llm import suffix_dedup as S

    r = random.Random(7)
    for _ in range(60):
        lengths, letters = r.choice([(2, 3), (3, 8)]), r.choice([b"ab", b"a", b"abcdef"])
        bodies = [bytes(r.choice(letters) for _ in range(r.randint(lengths[0], 60))) for _ in range(r.randint(1, 5))]
        bodies += bodies[:1]
        windows = [len(b) - lengths[0] + 1 for b in bodies]
        got = S.repeated_windows(bodies, [1] * len(bodies), windows, lengths, **limits)
        for length, hits in zip(lengths, got, strict=True):
            c = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
            assert [x.tolist() for x in hits] == [[i + length <= len(b) and c[b[i : i + length]] > 1 for i in range(n)] for b, n in zip(bodies, windows, strict=True)]


def test_neighbours():
    """Prefixes that start from what coarser steps found are those of plain comparison."""
    from foresail.llm.suffix_dedup import InducedSorter

    r = random.Random(1)
    for _ in range(60):
        letters = r.choice(["aab", "abcdefgh"])
        base = ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(4)] + ["a" * 90]
        raw = "".join(r.choice(base) + r.choice(["", "a", "c"]) for _ in range(30)).encode()
        x = InducedSorter(np.r_[np.frombuffer(raw, np.uint8).astype(np.int16), np.int16(0)], r.choice([5, 40, 400]))
        seeds = x._sorted_lms()
        assert x.neighbours(seeds)[1:].tolist() == x.prefix(seeds[:-1], seeds[1:]).tolist()


def test_shards_recurse_and_spill(spark, monkeypatch):
    """Tasks of the operator with small limits really recurse and write blocks; the repeats stay the same."""
    from foresail.llm import suffix_dedup as S

    r = random.Random(2)
    bodies = [bytes(r.choice(b"abc") for _ in range(300)) for _ in range(6)]
    bodies = [*bodies, *(b[:260] + bytes(r.choice(b"xyz") for _ in range(60)) for b in bodies)]
    frame = spark.createDataFrame([(i % 2, bytes([i]), 1, len(b) - S.SHORT + 1, bytearray(b)) for i, b in enumerate(bodies)], "h bigint, dig binary, m bigint, windows int, body binary")
    key = lambda d: sorted((x.h, bytes(x.dig), str(x.brief), str(x.ranges)) for x in d.collect())
    plain = key(S._sort_shards(frame))
    assert plain and plain == key(S._sort_shards(frame, 500, in_memory=4, queue_bytes=64))
    calls = []
    spill, run = S.DiskQueue._spill, S.InducedSorter.run
    monkeypatch.setattr(S.DiskQueue, "_spill", lambda self: (calls.append("spill"), spill(self))[1])
    monkeypatch.setattr(S.InducedSorter, "run", lambda self: (calls.append("run"), run(self))[1])
    S.repeated_windows(bodies, [1] * len(bodies), [len(b) - S.SHORT + 1 for b in bodies], in_memory=4, queue_bytes=64)
    assert calls.count("run") > 1 and "spill" in calls


def test_disk_queue_spills():
    from foresail.llm.suffix_dedup import DiskQueue

    q = DiskQueue(limit=64)
    for i in range(20):
        q.push(i % 3, np.arange(i, i + 4), np.full(4, i, np.uint16))
    pos, lcp = q.pop(1)
    assert pos.tolist() == [j for i in range(1, 20, 3) for j in range(i, i + 4)] and len(lcp) == len(pos) and q.pop(1) is None


def test_chat_round_trip(spark):
    from foresail.llm.chat import conversation_digests, with_probe

    data = [(1, 0, "user", "a<b>\\l\\"), (1, 1, "assistant", None), (1, 2, "assistant", "</turn>\n<turn user>"), (2, 5, None, ""), (1, 2, "assistant", "tie"), (None, 0, "assistant", "\\\\g")]
    got = {r.conv_id: r for r in conversation_digests(with_probe(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    for conv in (1, 2, None):
        turns = sorted([(t, r or "", x or "") for c, t, r, x in data if c == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[conv].n_turns == len(turns)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest() and got[conv].loss_chars == len(loss)
    assert got[-7].n_turns == 2


def test_chat_branches(spark):
    from foresail.llm.chat import format_conversations

    tree = spark.createDataFrame([(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 1.0, "assistant", "bad"), (1, 3, 1, 2.0, "assistant", "good"), (1, 4, 3, 0.5, "user", "more")], "tree bigint, node bigint, parent bigint, score double, role string, text string")
    got = format_conversations(tree, best=2).orderBy("rank").collect()
    assert ["good" in r.formatted for r in got] == [True, False] and "more" in got[0].formatted


def test_secrets(docs, rows):
    from foresail.llm.secret_scan import redact_secrets, scan_secrets

    got = {r.id: r for r in scan_secrets(docs, "doc_id", "text", Q.RANK_VOCAB, Q.PATTERN).collect()}
    assert got[13].n_assign == 1 and got[13].n_hex == 1 and got[14].n_access == 1 and got[1].spans == ""
    clean = {r.doc_id: r.text for r in redact_secrets(docs, "text", Q.RANK_VOCAB, Q.PATTERN).collect()}
    assert "abcdef0123456789abcd" not in clean[13] and clean[9] == rows[9][1] and clean[0] is None


def test_secret_rules():
    from foresail.llm.secret_scan import _vocabulary, find_spans

    enc = _vocabulary(Q.RANK_VOCAB, Q.PATTERN)
    assert find_spans("password: token: abcdefghijklmnop", enc) == []
    assert find_spans("x aG9zdGVkX2tleV8xMjM0NTY3ODkwQUJD/Zq+7 y", enc)[0][1] == 3
    assert find_spans("id 123e4567-e89b-12d3-a456-426614174000", enc) == []


def test_bpe(docs, rows):
    from tokenizers import Tokenizer

    from foresail.llm.bpe import TreeEncoder, bpe_encode

    t = Tokenizer.from_file(Q.JSON_VOCAB)
    got = {r.id: r for r in bpe_encode(docs, "doc_id", "text", Q.JSON_VOCAB, Q.PATTERN, leaf_chars=100).collect()}
    for r in rows:
        want = t.encode(r[1] or "", add_special_tokens=False).ids
        assert got[r[0]].ids == want and got[r[0]].decoded == t.decode(want, skip_special_tokens=False)
    tree = TreeEncoder(Q.JSON_VOCAB, Q.PATTERN, leaf_chars=7, window_chars=2)
    r = random.Random(1)
    for letters in ("ab ", "a 'sé1\n ", " \n", "the'll "):
        for _ in range(40):
            x = "".join(r.choice(letters) for _ in range(r.randint(0, 120))) + "<|endoftext|>" * r.randint(0, 1)
            assert tree.encode(x) == t.encode(x, add_special_tokens=False).ids


def test_mixing(docs, rows):
    from foresail.llm.mixing import fill_targets, mix, word_count

    got = mix(docs, "doc_id", "source", word_count(F.col("text"))).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) >= set(docs.columns)
    by = {}
    for r in got:
        assert 0 <= r["__taken"] <= 2 * r["__size"]
        s = by.setdefault(r.source, [0, r["__target"]])
        s[0] += r["__taken"]
    for taken, target in by.values():
        assert abs(taken - target) <= 1 + 0.02 * target
    assert fill_targets([("a", 100), ("b", 100), (None, 100)]) == {"a": 200.0, "b": pytest.approx(500 / 3), None: pytest.approx(250 / 3)}
    again = mix(docs, "doc_id", "source", word_count(F.col("text"))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_quality(docs, rows):
    from foresail.llm.quality import keep_good, quality_rules, repeat_words

    got = {r.id: r for r in quality_rules(docs, "doc_id", "text", "source").collect()}
    assert got[0].base_failed and not got[0].kept and not got[9].base_failed and got[15].n_dup_lines == 39
    words = [b"a", b"b", b"c", b"x", b"a", b"b", b"c"]
    assert repeat_words(words) == 6 and repeat_words(words[:3]) == 0
    kept = [r.doc_id for r in keep_good(docs, "text", "source").collect()]
    assert 9 in kept and 0 not in kept and all(got[i].kept for i in kept if i is not None)


def test_near_duplicates(docs, rows):
    from foresail.llm.minhash import near_duplicates

    sets = []
    for r in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in (r[1] or "")).encode().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), 1 << 60), r[0])
    want = sorted(str((r[0], len(sets[i]), least.get(find(i)), r[0] == least.get(find(i)))) for i, r in enumerate(rows))
    assert sorted(str(tuple(x)) for x in near_duplicates(docs, "doc_id", "text").collect()) == want


def test_fingerprints(docs, rows):
    from foresail.llm.fingerprint import edited_fingerprints

    got = edited_fingerprints(docs, "doc_id", "text").collect()
    assert len(got) == len(rows)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""), reverse=True)
    want = Counter()
    for i, r in enumerate(order):
        a, b = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(a) // 2
        want[(r[0], len(a), hashlib.sha256((a[: len(a) - h] + b[:h]).encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_chars, r.edited_sha256) for r in got) == want
    prints = {}
    for r in got:
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        prints.setdefault(r.doc_id, set()).add(r.fingerprint)
    assert prints[4] == prints[5] and len(prints[5]) == 1


def test_fingerprint_tracks_similarity(spark):
    from foresail.llm.fingerprint import likeness, with_fingerprint

    r = random.Random(2)
    pairs = []
    for part in (0.0, 0.3, 0.6, 0.9):
        same = prose(r, 1500).split()
        cut = int(1500 * part)
        pairs.append((part / (2 - part), " ".join(same), " ".join(same[:cut] + prose(r, 1500 - cut).split())))
    df = with_fingerprint(with_fingerprint(spark.createDataFrame(pairs, "j double, a string, b string"), "a", "fa"), "b", "fb")
    for row in df.select("j", likeness(F.col("fa"), F.col("fb")).alias("s")).collect():
        assert abs(row.j - row.s) < 0.16


def test_html_many_hosts(spark):
    """Hosts that are broadcast and hosts that are joined by salted keys give the same containers."""
    from foresail.llm.html_extract import _with_wrapper

    pages = spark.createDataFrame([(i, f"u{i}", "<p>x", "hot" if i % 3 else f"h{i}") for i in range(90)], "id long, url string, html string, host string").union(spark.sql("SELECT NULL, NULL, NULL, ''"))
    wrappers = spark.createDataFrame([("hot", "article "), ("h3", "main "), ("unseen", "div m")], "host string, container string")
    got = [sorted(map(str, _with_wrapper(pages, wrappers, limit).collect())) for limit in (3, 2)]
    assert got[0] == got[1] and len(got[0]) == 91


def test_toxicity(spark):
    from foresail.llm.toxicity import score_toxicity

    r = random.Random(4)
    docs, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        docs.append((i, prose(r, 60) + (" you moron " if bad else " fine ") + prose(r, 20)))
        if i % 2 == 0:
            labels.append((i, 1, int(bad)))
    docs += [(1000, None), (1001, "")]
    got = score_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"), "doc_id", "text").collect()
    import zlib

    held = [x for x in got if x.held_out and x.doc_id < 1000]
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert sum((x.doc_id % 5 == 0) == (x.predicted == 1) for x in held) / len(held) > 0.95
    none = score_toxicity(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "doc_id bigint, quality int, toxic int"), "doc_id", "text")
    assert {x.score for x in none.collect()} == {0.0}


PAGE = "<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a>Home</a></ul></nav><div class='sidebar'>side</div>{}<div id=comments><p>first!</p></div><form>sign up</form><footer>&copy; x</footer></body></html>"


def test_html(spark):
    from foresail.llm.html_extract import extract_pages

    pages = [(i, "http://h.example/%d" % i, PAGE.replace("{}", f"<article><header>by me</header><h1>T{i} &amp; Co</h1><p><b>One{i}.<br><p>Two\n  words<aside>ad</aside></article>")) for i in range(5)]
    pages += [(10, None, None), (11, "http://h.example/x", ""), (12, "http://o.example", PAGE.replace("{}", "<div class='post-content'><p>Plain &lt;b&gt;</p><script>x</script></div>"))]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(pages, "page_id bigint, url string, html string"), "page_id", "url", "html").collect()}
    assert got[2].text == "T2 & Co\nOne2.\nTwo words" and got[2].n_chars == len(got[2].text)
    assert got[10].text == "" and got[11].n_chars == 0 and got[12].text == "Plain <b>"


@pytest.mark.parametrize("name", ["op1", "op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_empty_tables(spark, tmp_path, name):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "page_id bigint, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    query = next(f for n, f in Q.queries().items() if n.startswith(name + "_"))
    assert query(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path, docs):
    import corpus_pipeline

    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r.doc_id for r in out}
    assert 9 in ids and 0 not in ids and len(ids & {4, 5, 6, 7}) <= 1 and all(r.n_tokens == len(r.ids) for r in out)
