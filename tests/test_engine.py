"""Operators on small fixtures with known values, and queries against their SQL."""

import math

import pytest
from pyspark.sql import functions as F

from foresail.config import EngineConfig
from foresail.functions import text as T
from foresail.operators import corpus, hmm, lexicon, profile
from foresail.operators.lm import NgramModel, prune
from foresail.operators.predict import Predictor, requests_from_buffers

LINES = ["our boat left at dawn", "our boat came home", "her boat left at noon", "our crew left at dawn", "the crew slept"]


def sents(spark, lines):
    return spark.createDataFrame([(i, line.split()) for i, line in enumerate(lines)], "sid bigint, tokens array<string>")


@pytest.fixture(scope="module")
def model(spark):
    return NgramModel.fit(sents(spark, LINES), 3).cached()


def test_config_checks():
    with pytest.raises(ValueError):
        EngineConfig(order=0)
    with pytest.raises(ValueError):
        EngineConfig(smoothing="none")
    with pytest.raises(KeyError):
        EngineConfig().override(nothing=1)


def test_text(spark):
    df = spark.createDataFrame([("Mail a.b@c.org or see https://x.com/y now.  It’s   done!",), ("",), ("भारत एक देश है। अच्छा।",)], "t string")
    rows = df.select(F.transform(T.split_sentences(T.clean_text(F.col("t"))), lambda s: T.tokenize(s)).alias("x")).collect()
    assert rows[0].x == [["Mail", "or", "see", "now", "."], ["It", "'", "s", "done", "!"]]
    assert rows[1].x == []
    assert rows[2].x == [["भारत", "एक", "देश", "है", "।"], ["अच्छा", "।"]]


def test_nfc(spark):
    df = spark.createDataFrame([("é",), ("क़",), (None,), ("x",)], "t string")
    assert {r.t for r in T.normalize_nfc(df, "t").collect()} == {"é", "क़", None, "x"}


def test_split_buffer(spark):
    cases = [("we sail north by ", ["north", "by"], ""), ("we sail north by nor", ["north", "by"], "nor"), ("Ahoy", [], "Ahoy"), ("", [], ""), (" \t ", [], ""), ("tide's up.", ["s", "up"], ".")]
    df = spark.createDataFrame([(c[0],) for c in cases], "b string")
    c, p = T.split_buffer(F.col("b"), 3)
    assert [tuple(r) for r in df.select(c, p).collect()] == [x[1:] for x in cases]


def test_candidate_tags(spark):
    words = [("grumbling", True, "VBG"), ("at", True, None), ("?;", True, "."), ("42", True, "CD"), ("Marlow", False, "NNP"), ("Marlow", True, None), ("नावों", True, "NN"), ("calmness", True, "NN")]
    df = spark.createDataFrame([w[:2] for w in words], "w string, f boolean")
    got = [r[0] for r in df.select(F.get(T.candidate_tags(F.col("w"), F.col("f")), 0)).collect()]
    assert got == [w[2] for w in words]


def test_counts_and_scores(model, spark):
    g = {(r.k, tuple(r.ctx), r.word): r["cnt"] for r in model.grams.collect()}
    assert g[(1, (), "boat")] == 3 and g[(2, ("our",), "boat")] == 2 and g[(3, ("<s>", "<s>"), "our")] == 3 and g[(1, (), "</s>")] == 5
    asked = spark.createDataFrame([(["our", "boat"], "left"), (["the", "crew"], "home")], "ctx array<string>, word string")
    s = {r.word: r for r in model.score(asked).collect()}
    assert s["left"].p_mle == pytest.approx(1 / 2) and s["left"].p_laplace == pytest.approx(2 / 16)
    assert s["home"].p_mle == 0.0


def test_candidates_score_like_the_model(model, spark):
    """The score that the search for candidates gives is that of the general scoring."""
    ctx = spark.createDataFrame([(["our", "boat"],), (["<s>", "the"],), (["no", "such"],)], "ctx array<string>")
    got = {(tuple(r.ctx), r.word): r.score for r in model.candidates(ctx, 10).collect()}
    rows = spark.createDataFrame([(list(c), w) for c, w in got], "ctx array<string>, word string")
    want = {(tuple(r.ctx), r.word): r.p_stupid_backoff for r in model.score(rows, ("stupid_backoff",)).collect()}
    assert got == pytest.approx(want) and len({c for c, _ in got}) == 3


def test_generate(model, spark):
    ctx = spark.createDataFrame([(["<s>", "<s>"],), (["no", "such"],), (["the", "crew"],)], "ctx array<string>")
    got = {tuple(r.ctx): r.generated for r in model.generate(ctx, 6).collect()}
    again = {tuple(r.ctx): r.generated for r in model.generate(ctx.unionByName(ctx), 6).collect()}
    assert got == again and len(got) == 3 and got[("the", "crew")] == ["slept", "</s>"]
    words = {r.word for r in model.grams.where("k = 1").collect()}
    assert all(set(x) <= words and "</s>" not in x[:-1] for x in got.values())


def test_mass_is_one(model, spark):
    ctx = spark.createDataFrame([(["<s>", "the"],), (["no", "such"],)], "ctx array<string>")
    for r in model.mass(ctx).collect():
        assert r.mass_laplace == pytest.approx(1.0) and r.mass_kneser_ney == pytest.approx(1.0)


def test_perplexity_infinite(model, spark):
    p = {r.method: r.perplexity for r in model.perplexity(sents(spark, ["the boat slept"])).collect()}
    assert math.isinf(p["mle"]) and not math.isinf(p["kneser_ney"])


def test_prune_keeps_unigrams(model):
    p = prune(model.grams, 2, 1)
    assert p.where("k = 1").count() == model.grams.where("k = 1").count()
    assert p.where("k > 1").groupBy("k", "ctx").count().where("count > 1").count() == 0


def test_lexicon(spark):
    w = spark.createDataFrame([("harbour", 5), ("hatch", 3), ("hammock", 3), ("oar", 1)], "word string, cnt bigint")
    asked = spark.createDataFrame([("ha",), ("zz",)], "asked string")
    assert [r.word for r in lexicon.complete(w, asked, 2).orderBy("rank").collect()] == ["harbour", "hammock"]
    assert {r.asked: r.has_prefix for r in lexicon.lookup(w, asked).collect()} == {"ha": True, "zz": False}


def test_profile_window_and_stream(spark, tmp_path):
    rows = [(1, i, f"word{i} filler".split()) for i in range(20)] + [(2, 0, ["a"] * 11)]
    df = spark.createDataFrame(rows, "user bigint, seq bigint, tokens array<string>")
    cfg = EngineConfig(profile_cap=10)
    obs = profile.observed(df)
    assert sorted(r.seq for r in profile.retained(obs, 10).where("user = 1").collect()) == [15, 16, 17, 18, 19]
    batch = {r.user: (r.tokens, r.sentences, r.vocabulary) for r in profile.stats(obs, cfg).collect()}
    assert batch == {1: (10, 5, 21), 2: (0, 0, 1)}
    from foresail.streaming.profile_stream import profile_stream

    df.write.parquet(str(tmp_path / "in"))
    stream = profile_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), cfg)
    q = stream.writeStream.outputMode("update").format("memory").queryName("prof").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {r.user: (r.tokens, r.sentences, r.vocabulary) for r in spark.table("prof").collect()}
    assert last == batch


def test_stream_of_gram_changes(spark, tmp_path):
    """Deltas of two batches, evictions among them, add up to the counts of what is retained."""
    from foresail.streaming.profile_stream import current_grams, gram_changes

    cfg = EngineConfig(profile_cap=6)
    rows = [(u, i, f"Word{i % 3} on deck".split()) for u in (1, 2) for i in range(5)] + [(3, 0, ["", "x"]), (3, 1, [])]
    df = spark.createDataFrame(rows, "user bigint, seq bigint, tokens array<string>")
    df.where("seq < 3").coalesce(1).write.parquet(str(tmp_path / "in/a"))
    df.where("seq >= 3").coalesce(1).write.parquet(str(tmp_path / "in/b"))
    for part in ("a", "b"):
        stream = gram_changes(spark.readStream.schema(df.schema).parquet(str(tmp_path / f"in/[a{part}]")), cfg)
        q = stream.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    key = lambda d: sorted((r.user, r.k, tuple(r.ctx), r.word, r["cnt"]) for r in d.collect())
    kept = profile.user_grams(profile.retained(profile.observed(df), 6), cfg)
    assert key(current_grams(spark.read.parquet(str(tmp_path / "out")))) == key(kept)


def test_profile_store(spark, tmp_path, model):
    from foresail.sources.bundle import ProfileStore, load_predictor, save_model

    at = str(tmp_path / "p")
    store = ProfileStore(spark, at, EngineConfig(profile_cap=4))
    assert store.observed().count() == 0
    df = spark.createDataFrame([(1, 0, ["Land", "ho"]), (1, 1, ["sail", "away", "now"]), (2, 0, ["sail"])], "user bigint, seq bigint, tokens array<string>")
    assert {(r.user, r.tokens) for r in store.observe(df).collect()} == {(1, 5), (2, 1)}
    words = lexicon.words_of_counts(model.grams.where("k = 1").select("word", "cnt"))
    added = Predictor(model, words).learn(store, spark.createDataFrame([(2, 5, "Sail on. Sail!")], "user bigint, seq bigint, text string"))
    assert [tuple(r) for r in added.collect()] == [(2, 5)]
    back = ProfileStore.load(spark, at)
    assert back.cfg.profile_cap == 4 and back.observed().count() == 5
    back.compact()
    assert sorted((r.user, r.seq) for r in back.observed().collect()) == [(1, 1), (2, 500_001)] or back.observed().where("user = 1").count() == 1
    save_model(model, str(tmp_path / "m"))
    p = load_predictor(spark, str(tmp_path / "m"), profile_path=at)
    req = requests_from_buffers(spark.createDataFrame([(1, 1, "sail ")], "req_id bigint, user bigint, buffer string"))
    assert "away" in {r.word for r in p.candidates(req).collect()}
    back.reset(spark.createDataFrame([(1,)], "user bigint"))
    assert {r.user for r in back.observed().collect()} == {2}
    back.reset()
    assert ProfileStore.load(spark, at).observed().count() == 0


def test_load_sources(spark, tmp_path):
    from foresail.sources.corpora import load_sentences, load_tagged

    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.txt").write_text("Set sail. Mind\nthe reef!", encoding="utf-8")
    (tmp_path / "t/b.txt").write_text("", encoding="utf-8")
    assert sorted(" ".join(r.tokens) for r in load_sentences(spark, str(tmp_path / "t")).collect()) == ["Mind the reef !", "Set sail ."]
    assert load_sentences(spark, "no_such_table", limit=1, fallback=str(tmp_path / "t/a.txt")).count() == 1
    with pytest.raises(FileNotFoundError):
        load_sentences(spark, str(tmp_path / "none"))
    with pytest.raises(FileNotFoundError):
        load_tagged(spark, str(tmp_path / "none"))


def test_settings(tmp_path, monkeypatch):
    from foresail import config

    f = tmp_path / "c.yaml"
    f.write_text("ngram:\n  order: 2\n  backoff_alpha: 0.5\nother: {x: 1}\n")
    monkeypatch.setenv(config.CONFIG_VARIABLE, str(f))
    s = config.load_settings()
    assert config.setting(s, "ngram.order") == 2 and config.setting(s, "ngram.none", 7) == 7 and config.from_settings(s).backoff_alpha == 0.5
    with pytest.raises(KeyError):
        config.setting(s, "ngram.none")


def test_guards(spark):
    empty = spark.createDataFrame([], "sid bigint, pos int, word string, tag string")
    with pytest.raises(ValueError):
        hmm.HMMTagger(empty).load()
    for wrong in ({"hmm_k": 0.0}, {"unknown_strategy": "x"}, {"unknown_prior": "x"}, {"train": 0.9}):
        with pytest.raises(ValueError):
            EngineConfig(**wrong)
    with pytest.raises(ValueError):
        corpus.assign_split(empty.select("sid"), (("train", 1.2), ("test", -0.2)))
    with pytest.raises(ValueError):
        T.pad(F.lit(None), 0, "a", "b")


def test_nothing_asked(spark, model):
    words = lexicon.words_of_counts(model.grams.where("k = 1").select("word", "cnt"))
    p, none = Predictor(model, words), spark.createDataFrame([], "ctx array<string>, prefix string, target string")
    assert tuple(p.keystroke_savings(none).first()) == (0, 0, 0, 0, 0.0)
    assert p.hit_at_k(none).first().positions == 0


def test_splits(spark):
    ids = spark.range(1000).withColumnRenamed("id", "sid")
    got = {r.split: r["count"] for r in corpus.assign_split(ids).groupBy("split").count().collect()}
    assert got == {"train": 800, "dev": 100, "test": 100}
    assert corpus.assign_split(ids.limit(0)).count() == 0


def test_viterbi_brute_force(spark):
    import itertools

    text = [[("our", "DET"), ("crew", "NOUN"), ("rows", "VERB")], [("our", "DET"), ("mate", "NOUN"), ("rows", "VERB")], [("rows", "NOUN"), ("tilt", "VERB")], [("her", "DET"), ("crew", "NOUN"), ("rests", "VERB")]]
    df = spark.createDataFrame([(i, j, w, t) for i, s in enumerate(text) for j, (w, t) in enumerate(s)], "sid bigint, pos int, word string, tag string")
    t = hmm.HMMTagger(df, EngineConfig(hmm_k=0.1)).load()
    for row in t.log_transition:
        i = t.log_transition.index(row)
        assert sum(map(math.exp, row)) + math.exp(t.log_final[i]) == pytest.approx(1.0)
    ask = spark.createDataFrame([(0, 0, "our"), (0, 1, "crew"), (0, 2, "heaving")], "sid bigint, pos int, word string")
    e = {r.pos: r.emit for r in t.with_emissions(ask).collect()}
    best = max(itertools.product(range(3), repeat=3), key=lambda p: t.log_initial[p[0]] + t.log_transition[p[0]][p[1]] + t.log_transition[p[1]][p[2]] + t.log_final[p[2]] + sum(e[i][x] for i, x in enumerate(p)))
    got = t.decode(ask).first()
    assert got.path == [t.tags[i] for i in best]
    columns = t.trellis(ask).first().trellis
    assert t.last_tags(ask).first().tag == t.tags[columns[-1].index(max(columns[-1]))] and len(columns) == 3


def test_viterbi_long_and_short(spark):
    """A sentence of several blocks and one of one word, against a plain loop."""
    import random

    r = random.Random(5)
    rows = [(0, i, r.choice("abc"), r.choice("XYZ")) for i in range(300)]
    t = hmm.HMMTagger(spark.createDataFrame(rows, "sid bigint, pos int, word string, tag string")).load()
    ask = [[r.choice("abcd") for _ in range(n)] for n in (1, 2, 64, 65, 66, 200)]
    df = spark.createDataFrame([(i, j, w) for i, s in enumerate(ask) for j, w in enumerate(s)], "sid bigint, pos int, word string")
    emit = {(x.sid, x.pos): x.emit for x in t.with_emissions(df).collect()}
    got = {x.sid: x.path for x in t.decode(df).collect()}
    n = range(len(t.tags))
    for sid, s in enumerate(ask):
        v, back = [t.log_initial[j] + emit[sid, 0][j] for j in n], []
        for pos in range(1, len(s)):
            ways = [[v[i] + t.log_transition[i][j] for i in n] for j in n]
            back.append([w.index(max(w)) for w in ways])
            v = [max(ways[j]) + emit[sid, pos][j] for j in n]
        end = [v[j] + t.log_final[j] for j in n]
        path = [end.index(max(end))]
        for b in reversed(back):
            path.insert(0, b[path[0]])
        assert got[sid] == [t.tags[i] for i in path]


def test_rerank_alpha_zero_is_identity(spark, model):
    words = lexicon.words_of_counts(model.grams.where("k = 1 AND word NOT IN ('<s>', '</s>')").select("word", "cnt"))
    tagged = corpus.tokens(sents(spark, LINES)).select("sid", "pos", F.col("tok").alias("word"), F.when(F.col("tok").isin("the", "a"), "DET").otherwise("NOUN").alias("tag"))
    buffers = spark.createDataFrame([(1, None, "our "), (2, None, "our c"), (3, None, "")], "req_id bigint, user bigint, buffer string")
    req = requests_from_buffers(buffers)
    plain = [(r.req_id, r["rank"], r.word) for r in Predictor(model, words).predict(req).orderBy("req_id", "rank").collect()]
    cfg = EngineConfig(rerank_alpha=0.0)
    again = [(r.req_id, r["rank"], r.word) for r in Predictor(model, words, tagger=hmm.HMMTagger(tagged).load(), cfg=cfg).predict(req).orderBy("req_id", "rank").collect()]
    assert plain == again and plain


def test_conll(spark, tmp_path):
    from foresail.sources.conll import read_conll, write_conll

    df = spark.createDataFrame([(0, 0, "राम", "NNP"), (0, 1, "।", "PUNC"), (1, 0, "a", "DET")], "sid bigint, pos int, word string, tag string")
    write_conll(df.coalesce(1), str(tmp_path / "c"))
    rows = read_conll(spark, str(tmp_path / "c")).orderBy("file", "sent", "pos").collect()
    assert [(r.word, r.tag) for r in rows] == [("राम", "NNP"), ("।", "PUNC"), ("a", "DET")] and len({(r.file, r.sent) for r in rows}) == 2


def test_clean_tagged(spark):
    df = spark.createDataFrame([(0, 0, " राम", "NNP"), (0, 1, "है।", "VM"), (0, 2, "x", " "), (0, 3, "॥", "PUNC")], "sid bigint, pos int, word string, tag string")
    assert [(r.word, r.tag) for r in hmm.clean_tagged(df).orderBy("pos").collect()] == [("राम", "NNP"), ("है", "VM"), ("।", "PUNC"), ("॥", "PUNC")]


def test_model_bundle(spark, model, tmp_path):
    from foresail.sources.bundle import load_model, save_model

    save_model(model, str(tmp_path / "m"))
    again = load_model(spark, str(tmp_path / "m"))
    assert again.grams.count() == model.grams.count() and again.order == 3


def test_catalog_has_callables():
    import __spark_entry__ as E

    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) > 90


def test_sentences_are_tokenized_once(spark):
    docs = spark.createDataFrame([(1, "It is done. ___ Cannot go!", "en"), (2, None, "en")], "doc_id bigint, text string, lang string")
    s = corpus.sentences(docs)
    assert s._jdf.queryExecution().executedPlan().toString().count("regexp_extract_all(") == 1
    assert sorted((r.sid, r.tokens) for r in s.collect()) == [(1_000_000, ["It", "is", "done", "."]), (1_000_001, ["Can", "not", "go", "!"])]


def test_guarded_cleaning_is_the_plain_one(spark):
    """Odd texts, against the patterns applied everywhere."""
    odd = ["a@b.c d", "@", "HTTPS://X.y z", "httpſ://a.b c", "see a.ıo/x or b.İO and c.COM, d.edU!", "www.x", "wWw.y.", "a  b", "a\t b", "  x  y ", "‘q’ – “r” — s", "cannot CANNOT Cannot. can’t DON'T it’s we'll", "x'ſ y", "", "1.5,3 a-b-c d’e’f ñandú étude-x_y ½ ५ ९.१ 🙂a"]
    df = spark.createDataFrame([(x,) for x in [*odd, None]], "t string")
    t = F.col("t")
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(t, T.CONTROL, " "), "(?U)" + T.EMAIL, " "), "(?iU)" + T.URL, " ")
    plain = F.trim(F.regexp_replace(F.translate(plain, T.CURLY, T.STRAIGHT), T.SPACE, " "))
    words = t
    for p in T.CONTRACTIONS:
        words = F.regexp_replace(words, "(?iU)" + p, "$1 $2")
    words = F.regexp_extract_all(words, F.lit(T.TOKEN), F.lit(0))
    for r in df.select("t", plain.alias("a"), T.clean_text(t).alias("b"), words.alias("c"), T.tokenize(t).alias("d"), T.has_token(t).alias("e")).collect():
        assert (r.a, r.c) == (r.b, r.d) and (r.e is None if r.c is None else r.e == bool(r.c)), r.t


def test_numbered_grams_are_those_of_arrays(spark, monkeypatch):
    from foresail.operators import lm

    text = sents(spark, [*LINES, "x", "our our our our"]).unionByName(spark.createDataFrame([(-5, []), (1 << 40, ["our", "boat"]), (7, None)], "sid bigint, tokens array<string>"))
    key = lambda g: sorted((r.k, tuple(r.ctx), r.word, r["cnt"], tuple(r.first_seen)) for r in g.collect())
    for order in (1, 2, 3, 4):
        monkeypatch.undo()
        got = lm.count_grams(text, order)
        assert "mapInArrow" in got._jdf.queryExecution().logical().toString() or "MapInArrow" in got._jdf.queryExecution().logical().toString()
        monkeypatch.setattr(lm, "few_words", lambda words: None)
        want = lm.count_grams(text, order)
        assert key(got) == key(want) and got.schema.simpleString() == want.schema.simpleString()


def test_unknown_words_in_place_and_by_a_join(spark, monkeypatch):
    text = spark.createDataFrame([(1, "a", ["Our", "boat", "sank", None]), (2, "b", []), (3, "c", ["our"])], "sid bigint, split string, tokens array<string>")
    vocab = spark.createDataFrame([("our", True), ("boat", True), ("sank", False)], "word string, in_vocab boolean")
    got = sorted(map(tuple, corpus.apply_unk(text, vocab).select("sid", "split", "tokens").collect()))
    monkeypatch.setattr(corpus, "MOST_WORDS", 1)
    assert got == sorted(map(tuple, corpus.apply_unk(text, vocab).select("sid", "split", "tokens").collect()))
    assert got == [(1, "a", ["our", "boat", "<UNK>", "<UNK>"]), (3, "c", ["our"])]


def test_tagger_of_words(spark):
    text = sents(spark, [*LINES, "boat"])
    tag = lambda w: F.when(w.isin("our", "her", "the"), "DET").otherwise(F.concat(F.lit("L"), F.length(w).cast("string")))
    rows = corpus.tokens(text).select("sid", "pos", F.col("tok").alias("word"), tag(F.col("tok")).alias("tag"))
    a, b = hmm.HMMTagger(rows).load(), hmm.HMMTagger.of_words(text, tag).load()
    for name in ("tags", "totals", "starts", "finals", "trans", "n_words", "hapax", "most_frequent", "log_transition", "unk_hapax"):
        assert getattr(a, name) == getattr(b, name)
    key = lambda t: sorted((r.word, r.tag, r["cnt"], tuple(r.seen)) for r in t.emissions.collect())
    assert key(a) == key(b)


@pytest.mark.parametrize("name", ["trie_words", "typical_tag", "context_tag", "tag_score", "tag_window_disagreement", "typical_tag_agreement", "typical_tag_confusions"])
def test_words_and_tags_need_no_grams(spark, monkeypatch, name):
    """Queries of words and tags alone count no n-grams, at any size."""
    from foresail import catalog

    def none(self):
        raise AssertionError("counts n-grams")

    monkeypatch.setattr(catalog.Base, "model", property(none))
    monkeypatch.setattr(catalog.Base, "corpus", property(none))
    rows = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    assert rows.count() or name == "typical_tag_confusions"


def test_generate_makes_stretches_of_asked_contexts_alone(spark, model, monkeypatch):
    made, whole = [], NgramModel.sampling_table
    monkeypatch.setattr(NgramModel, "sampling_table", lambda self, grams=None: made.append(grams) or whole(self, grams))
    ctx = spark.createDataFrame([(["the", "crew"],), (["no", "such"],)], "ctx array<string>")
    assert {tuple(r.ctx): r.generated for r in model.generate(ctx, 2).collect()}[("the", "crew")] == ["slept", "</s>"]
    assert len(made) == 3 and None not in made
    assert {tuple(r.ctx) for r in made[1].collect()} == {("the", "crew"), ("crew",)}


def test_backoff_alone_is_that_of_all_methods_in_fewer_joins(spark, model):
    asked = spark.createDataFrame([(["our", "boat"], "left"), (["the", "crew"], "home"), (["no", "such"], "word"), (["<s>", "<s>"], "<s>"), (["our", "our"], "boat")], "ctx array<string>, word string")
    one = model.score(asked, ("stupid_backoff",))
    want = {(tuple(r.ctx), r.word): r.p_stupid_backoff for r in model.score(asked, ("mle", "stupid_backoff")).collect()}
    assert {(tuple(r.ctx), r.word): r.p_stupid_backoff for r in one.collect()} == pytest.approx(want)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Join LeftOuter") <= model.order + 1


def test_one_ranking_serves_all_prunings(spark, model):
    from foresail.operators.lm import prune_ranked, ranked

    grams, key = ranked(model.grams), lambda g: sorted((r.k, tuple(r.ctx), r.word, r["cnt"]) for r in g.collect())
    for least, most in ((1, 0), (1, 1), (2, 0), (2, 1), (3, 2)):
        assert key(prune_ranked(grams, least, most)) == key(prune(model.grams, least, most))
