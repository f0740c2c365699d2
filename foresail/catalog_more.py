"""More of the catalog: generation, tagger experiments, prediction with users and tags, and saved artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import Window, functions as F

from . import catalog as K
from .catalog import C, S, T, add, joined, r6
from .operators import corpus, hmm, lexicon, predict, profile
from .operators.lm import NgramModel, prune_ranked, ranked
from .sources import bundle, corpora

big = lambda c: F.col(c).cast("bigint").alias(c)
SPECIAL = "('<s>', '</s>', '<UNK>')"
KEEP_SETTINGS = ((1, 0), (2, 50), (2, 20), (3, 20), (5, 10))
ALPHAS = (0.0, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0, 2.0)
KS = (1.0, 0.1, 0.01, 0.001, 1e-4, 1e-5)
WINDOWS = (1, 2, 3, 5)
LANGUAGES = ("en", "de", "fr", "es")


# --- language model


def _pruning(b):
    """Grams, bytes of their words (a count of 8 bytes each) and perplexity for a range of settings, of one fit."""
    out = None
    dev, grams = b.parts.where("split = 'dev'"), bundle.materialize(ranked(b.model.grams))
    for least, most in KEEP_SETTINGS:
        p = NgramModel(prune_ranked(grams, least, most), b.model.vocab, 3)
        row = K._ppl(p.perplexity(dev, ("stupid_backoff", "kneser_ney")))
        size = F.octet_length(F.array_join("ctx", " ")) + F.octet_length("word") + 8
        row = row.crossJoin(p.grams.agg(F.count("*").alias("grams"), F.sum(size).alias("bytes")))
        row = row.select(
            F.lit(least).cast("bigint").alias("min_count"), F.lit(most).cast("bigint").alias("most"), "grams", "bytes", "method", "perplexity"
        )
        out = row if out is None else out.unionByName(row)
    return out


def _pruning_sql() -> str:
    dev = S.places("(SELECT * FROM corpus WHERE split = 'dev')", "dp") + ",\nasked AS (SELECT w1, w2, w, count(*) AS n FROM dp GROUP BY ALL)"
    parts = []
    for least, most in KEEP_SETTINGS:
        cut = lambda keys, g: f"""(SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cnt DESC, fs) AS r FROM {g} WHERE cnt >= {least}) WHERE r <= {most or 1 << 40})"""  # noqa: E731, B023
        size = """SELECT count(*) AS grams, sum(b)::BIGINT AS bytes FROM (SELECT strlen(w) + 8 AS b FROM g1 UNION ALL SELECT strlen(w2) + strlen(w) + 8 FROM f2
 UNION ALL SELECT strlen(w1) + 1 + strlen(w2) + strlen(w) + 8 FROM f3)"""
        rows = " UNION ALL ".join(
            f"SELECT {least}::BIGINT AS min_count, {most}::BIGINT AS most, grams, bytes, '{m}' AS method, round(exp(-sum(n * ln(p_{m})) / sum(n)), 4) AS perplexity FROM sc, sz GROUP BY grams, bytes" for m in ("stupid_backoff", "kneser_ney")
        )
        parts.append(
            f"SELECT * FROM (WITH {S.LM},\nf3 AS {cut('w1, w2', 'g3')}, f2 AS {cut('w2', 'g2')},\n{S.derived('f3', 'f2')},\n{dev}, sz AS ({size}),"
            f" sc AS ({S.score('asked', 3, 'f3', 'f2')}) {rows})"
        )
    return "\nUNION ALL ".join(parts)


add("pruning_report", _pruning, select=_pruning_sql())


def _generate_sql(steps: int) -> str:
    out = []
    for k, keys, g in ((3, "PARTITION BY w1, w2", "g3"), (2, "PARTITION BY w2", "g2"), (1, "", "g1")):
        order = f"{keys} ORDER BY substr(md5(w), 1, 2), w"
        out.append(f"cum{k} AS (SELECT *, hi - cnt AS lo FROM (SELECT *, sum(cnt) OVER ({order}) AS hi, sum(cnt) OVER ({keys}) AS total FROM {g}))")
    out.append("st0 AS (SELECT DISTINCT w1 AS a, w2 AS b, w1, w2, []::VARCHAR[] AS gen FROM hp)")
    for i in range(steps):
        at = lambda k: f"floor(s.u * c{k}.total) >= c{k}.lo AND floor(s.u * c{k}.total) < c{k}.hi"
        out.append(f"""un{i} AS (SELECT *, ('0x' || substr(md5('0:{i}:' || a || ' ' || b), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u, coalesce(gen[-1] = '</s>', false) AS done FROM st{i}),
dr{i} AS (SELECT s.*, coalesce(c3.w, c2.w, c1.w) AS new FROM un{i} s LEFT JOIN cum3 c3 ON c3.w1 = s.w1 AND c3.w2 = s.w2 AND {at(3)}
 LEFT JOIN cum2 c2 ON c2.w2 = s.w2 AND {at(2)} LEFT JOIN cum1 c1 ON {at(1)}),
st{i + 1} AS (SELECT a, b, CASE WHEN done THEN w1 ELSE w2 END AS w1, CASE WHEN done THEN w2 ELSE new END AS w2, CASE WHEN done THEN gen ELSE gen || [new] END AS gen FROM dr{i})""")
    return ",\n".join(out)


add(
    "generate", lambda b: b.model.generate(b.contexts.select("ctx"), 5).select(joined("ctx", "ctx"), joined("generated", "generated")),
    S.LM, S.HELD, _generate_sql(5), select="SELECT a || ' ' || b AS ctx, array_to_string(gen, ' ') AS generated FROM st5",
)

# --- tagger experiments

ROWS = "te"
_EV3 = """round(avg((gold = pred)::INT), 6) AS accuracy, round(coalesce(avg((gold = pred)::INT) FILTER (known), 0), 6) AS known_accuracy,
 round(coalesce(avg((gold = pred)::INT) FILTER (NOT known), 0), 6) AS unknown_accuracy"""


def _preds(n: str = "") -> str:
    return f"""preds{n} AS (SELECT te.sid, te.pos, te.word, te.tag AS gold, p.tag AS pred,
  te.word IN (SELECT word FROM wds) OR lower(te.word) IN (SELECT word FROM wds) AS known FROM te JOIN path{n} p ON p.sid = te.sid AND p.pos = te.pos)"""


def _scores(df, *more):
    return K._ev(hmm.evaluate(df)).select(*more, "accuracy", "known_accuracy", "unknown_accuracy")


def _user_rows(b):
    """Each user's events as one long sentence."""
    u = b.tagged.select((F.col("sid") / 1000).cast("bigint").alias("u"), "sid", "pos", "word")
    w = Window.partitionBy("u").orderBy("sid", "pos")
    return u.select(F.col("u").alias("sid"), (F.row_number().over(w) - 1).alias("pos"), "word")


add(
    "viterbi_underflow", lambda b: b.tagger.underflow(_user_rows(b)).select("sid", big("n"), "underflowed"), S.HMM,
    "uo AS (SELECT sid // 1000 AS sid, row_number() OVER (PARTITION BY sid // 1000 ORDER BY sid, pos) - 1 AS pos, word FROM tagged)",
    "uw AS (SELECT DISTINCT word, pos = 0 AS f FROM uo)", S.emissions("uw"),
    "em AS (SELECT r.sid, r.pos, e.tag, exp(e.lp) AS p FROM uo r JOIN emis e ON e.word = r.word AND e.f = (r.pos = 0))",
    """lv AS (SELECT em.sid, em.pos, em.tag, exp(i.lp) * em.p AS s FROM em JOIN h_init i USING (tag) WHERE em.pos = 0
 UNION ALL SELECT sid, pos, tag, m * p FROM (SELECT em.sid, em.pos, em.tag, em.p, max(lv.s * exp(t.lp)) AS m FROM lv JOIN h_trans t ON t.prev = lv.tag
  JOIN em ON em.sid = lv.sid AND em.pos = lv.pos + 1 AND em.tag = t.tag GROUP BY ALL))""",
    "le AS (SELECT sid, max(pos) AS pos, count(*) AS n FROM uo GROUP BY sid)",
    select="SELECT sid, n, max(s * exp(f.lp)) <= 0 AS underflowed FROM lv JOIN le USING (sid, pos) JOIN h_final f USING (tag) GROUP BY sid, n", recursive=True,
)

GRID = [(p, s) for p in ("hapax", "laplace") for s in ("suffix", "uniform", "most_frequent_tag")]


def _unknown_grid(b):
    out = None
    for p, s in GRID:
        row = _scores(b.tagger.predictions(b.tag_test, strategy=s, prior=p), F.lit(p).alias("prior"), F.lit(s).alias("strategy"))
        out = row if out is None else out.unionByName(row)
    return out


add(
    "unknown_word_ablation", _unknown_grid, S.HMM, *[
        f"{S.decoded('te', str(i), prior=p, strategy=s)},\n{_preds(str(i))}" for i, (p, s) in enumerate(GRID)
    ],
    select=" UNION ALL ".join(f"SELECT '{p}' AS prior, '{s}' AS strategy, {_EV3} FROM preds{i}" for i, (p, s) in enumerate(GRID)), recursive=True,
)


def _k_sweep(b):
    """One set of counts; the constant only changes the parameters derived from them."""
    out = None
    for k in KS:
        row = _scores(b.tagger.smoothed(k).predictions(b.tag_test), F.lit(k).alias("k"))
        out = row if out is None else out.unionByName(row)
    return out


add("smoothing_sweep", _k_sweep, select="\nUNION ALL ".join(
    f"SELECT * FROM (WITH RECURSIVE {S.TAGGED}, {S.TSPLIT},\n{S.hmm_tables(k)},\n{S.decoded('te')},\n{_preds()} SELECT {k}::DOUBLE AS k, {_EV3} FROM preds)" for k in KS
))


def _languages(b):
    """One row by language: shape of the tagged corpus, tagger and most-frequent-tag baseline on the same split."""
    out = None
    rows = bundle.materialize(b.shaped.join(b.sents.select("sid", "lang"), "sid"))
    for lang in LANGUAGES:
        tagged = rows.where(F.col("lang") == lang).drop("lang")
        if tagged.isEmpty():
            continue
        split = corpus.assign_split(bundle.materialize(tagged.select("sid").distinct()), (("train", 0.8), ("test", 0.2)))
        parts = bundle.materialize(tagged.join(split, "sid"))
        train, test = (parts.where(f"split = '{x}'").drop("split") for x in ("train", "test"))
        t = hmm.HMMTagger(train).load()
        t.emissions = bundle.materialize(t.emissions)
        base = test.withColumn("lower", F.lower("word")).join(hmm.baseline(train).withColumnRenamed("tag", "best"), "lower", "left")
        hit = (F.coalesce("best", F.lit(t.most_frequent)) == F.col("tag")).cast("double")
        base = base.agg(F.round(F.avg(hit), 6).alias("baseline_accuracy"))
        sizes = split.agg(
            F.count_if(F.col("split") == "train").alias("train_sentences"), F.count_if(F.col("split") == "test").alias("test_sentences")
        )
        scores = K._ev(hmm.evaluate(t.predictions(test))).drop("tokens")
        stats = hmm.tagged_stats(tagged).select(F.lit(lang).alias("language"), "sentences", "tokens", "types", r6("ttr"), "tags")
        row = stats.crossJoin(sizes).crossJoin(scores).crossJoin(base)  # one row each
        out = row if out is None else out.unionByName(row)
    return out


def _languages_sql() -> str:
    parts = []
    for lang in LANGUAGES:
        shaped = f"own AS (SELECT sid FROM sents JOIN documents d USING (doc_id) WHERE d.lang = '{lang}'),\n{S.SHAPE} WHERE sid IN (SELECT sid FROM own))"
        shaped = shaped.replace("FROM toks) WHERE", "FROM toks WHERE")
        parts.append(f"""SELECT * FROM (WITH RECURSIVE {S.sents()}, {S.TOKS},\n{shaped},\n{S.TSPLIT},\n{S.hmm_tables()},\n{S.decoded_lists('te')},\n{_preds()},\n{K.BASELINE},
mf AS (SELECT tag FROM (SELECT tag, count(*) AS c, min({{'s': sid, 'p': pos}}) AS fs FROM tr GROUP BY tag ORDER BY c DESC, fs LIMIT 1)),
st AS (SELECT count(DISTINCT sid) AS sentences, count(*) AS tokens, count(DISTINCT word) AS types, round(count(DISTINCT word) / count(*), 6) AS ttr, count(DISTINCT tag) AS tags FROM tagged),
sp AS (SELECT count(*) FILTER (split = 'train') AS train_sentences, count(*) FILTER (split = 'test') AS test_sentences FROM tsplit),
ev AS (SELECT {_EV3}, round(avg((NOT known)::INT), 6) AS oov_rate FROM preds),
ba AS (SELECT round(avg((coalesce(b.tag, (SELECT tag FROM mf)) = te.tag)::INT), 6) AS baseline_accuracy FROM te LEFT JOIN bl b ON lower(te.word) = b.lower)
SELECT '{lang}' AS language, * FROM st, sp, ev, ba WHERE sentences > 0)""")
    return "\nUNION ALL ".join(parts)


add("language_comparison", _languages, select=_languages_sql())

# --- prediction: every user's turns, as typed so far in three states


def _buffers(b):
    """(conv_id, turn, state, buffer): the whole turn, with a blank after it, and without its last three characters."""
    c = b.table("conversations").where("role = 'user'").select(
        "conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("state")
    )
    typed = F.when(F.col("state") == 0, F.col("text")).when(F.col("state") == 1, F.concat("text", F.lit(" ")))
    typed = typed.otherwise(F.substring("text", F.lit(1), F.greatest(F.length("text") - 3, F.lit(0))))
    return c.select("conv_id", "turn", F.col("state").cast("bigint").alias("state"), typed.alias("buffer"))


def _asked(b, users=False):
    """Requests by turn and state, and the distinct ones of them, which are predicted once."""
    rows = _buffers(b).withColumn("req_id", F.struct("conv_id", "turn", "state")).withColumn(
        "user", F.col("conv_id") if users else F.lit(None).cast("bigint")
    )
    asked = predict.requests_from_buffers(rows)
    once = bundle.materialize(asked.select("user", "ctx", "prefix").distinct().withColumn("req_id", F.monotonically_increasing_id()))
    return asked.select("req_id.*", "user", "ctx", "prefix"), once


def _back(asked, answers, *cols):
    same = (asked["ctx"] == answers["ctx"]) & (asked["prefix"] == answers["prefix"]) & asked["user"].eqNullSafe(answers["user"])
    return asked.join(answers, same).select("conv_id", "turn", "state", *cols)


def _predictor(b, tagger=False, users=False, cfg=C, truecase=False):
    mine = {"grams": b.user_grams, "user_words": profile.user_words(b.observed), "user_stats": profile.stats(b.observed)} if users else {}
    return predict.Predictor(b.small, b.lexicon, b.truecase if truecase else None, tagger=b.shape_tagger if tagger else None, cfg=cfg, **mine)


def _tags(b):
    """A predictor for tags alone, which need no model."""
    return predict.Predictor(None, b.lexicon, tagger=b.shape_tagger, cfg=C)


REQ = f"""rb AS (SELECT conv_id, turn, state, CASE state WHEN 0 THEN text WHEN 1 THEN text || ' ' ELSE substring(text, 1, greatest(length(text) - 3, 0)) END AS text
 FROM (SELECT conv_id, turn, coalesce(text, '') AS text, unnest([0, 1, 2]::BIGINT[]) AS state FROM conversations WHERE role = 'user')),
rt AS (SELECT conv_id, turn, state, text, {S.toks('trim(text)')} AS t FROM rb),
ro AS (SELECT *, NOT regexp_matches(text, '\\s$') AND length(text) > 0 AND len(t) > 0 AS o FROM rt),
rl AS (SELECT conv_id, turn, state, ['<s>', '<s>'] || list_transform(CASE WHEN o THEN t[1:len(t) - 1] ELSE t END, lambda x: lower(x)) AS c, CASE WHEN o THEN lower(t[-1]) ELSE '' END AS prefix FROM ro),
rq AS (SELECT conv_id, turn, state, c[-2] AS w1, c[-1] AS w2, prefix FROM rl),
rn AS (SELECT DISTINCT w1, w2 FROM rq WHERE prefix = ''),
rp AS (SELECT DISTINCT w1, w2, prefix FROM rq WHERE prefix <> '')"""
POOL = f"""pool AS (SELECT w1, w2, w, p_stupid_backoff AS p FROM (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY {S.rk('p_stupid_backoff')} DESC, w) AS pr FROM cand)
 WHERE pr <= {C.pool} AND w NOT IN {SPECIAL})"""


def _completions(asked: str, out: str) -> str:
    """out(w1, w2, prefix, w, p): the pool of each prefix, scored."""
    return f"""{out}_q AS (SELECT DISTINCT prefix FROM {asked}),
{out}_pool AS (SELECT prefix, word FROM (SELECT pref.prefix, word, row_number() OVER (PARTITION BY pref.prefix ORDER BY cnt DESC, word) AS r FROM pref JOIN {out}_q USING (prefix)) WHERE r <= {C.pool}),
{out}_c AS (SELECT DISTINCT a.w1, a.w2, a.prefix, p.word AS w FROM {asked} a JOIN {out}_pool p USING (prefix)),
{out} AS (SELECT w1, w2, prefix, w, p_stupid_backoff AS p FROM ({S.score(out + '_c', 3, 'f3', 'f2')}))"""


#: rc(w1, w2, prefix, mode, w, p): all candidates of the requests
BOTH = (
    S.SMALL, K.LEX, K.PREF, REQ, S.candidates("rn", C.pool), POOL, _completions("rp", "comp"),
    "rc AS (SELECT w1, w2, '' AS prefix, 'next_word' AS mode, w, p FROM pool UNION ALL SELECT w1, w2, prefix, 'completion', w, p FROM comp)",
)
SHOWN = "SELECT q.conv_id, q.turn, q.state, x.r AS rank, {} FROM rq q JOIN {} x ON x.w1 = q.w1 AND x.w2 = q.w2 AND x.prefix = q.prefix WHERE x.r <= 3"


def _suggest(b):
    asked, once = _asked(b)
    p = _predictor(b, truecase=True)
    r = p.rank(p.scored(once)).select(
        "user", "ctx", "prefix", big("rank"), F.col("shown").alias("word"), r6("score"), F.lit("base").alias("source"), "mode"
    )
    return _back(asked, r, "rank", "word", "score", "source", "mode")


add(
    "suggest", _suggest, *BOTH, S.TOKS, K.TC,
    f"rr AS (SELECT *, row_number() OVER (PARTITION BY w1, w2, prefix ORDER BY {S.rk('p')} DESC, shown) AS r"
    f" FROM (SELECT rc.*, coalesce(surface, w) AS shown FROM rc LEFT JOIN truecase t ON t.lower = w))",
    select=SHOWN.format("x.shown AS word, round(x.p, 6) AS score, 'base' AS source, x.mode", "rr"),
)


def _personalised(b):
    asked, once = _asked(b, users=True)
    p = _predictor(b, users=True)
    r = p.rank(p.scored(once)).select(
        "user", "ctx", "prefix", big("rank"), F.col("shown").alias("word"), F.round("score", 9).alias("score"),
        F.when(F.col("of_user") > 0, "user").otherwise("base").alias("source"), "mode"
    )
    return _back(asked, r, "rank", "word", "score", "source", "mode")


add(
    "predict_personalised", _personalised, *BOTH, K._US(), S.USER_GRAMS,
    'ra AS (SELECT DISTINCT conv_id AS "user", w1, w2, prefix FROM rq)', "rua AS (SELECT * FROM ra WHERE prefix = '')", S.user_candidates("rua", C.pool),
    'uwc AS (SELECT "user", word, count(*) AS cnt FROM (SELECT "user", unnest(tokens) AS word FROM obs) GROUP BY ALL)',
    f"""upc AS (SELECT "user", prefix, word FROM (SELECT r."user", r.prefix, u.word, row_number() OVER (PARTITION BY r."user", r.prefix ORDER BY cnt DESC, word) AS r
 FROM (SELECT DISTINCT "user", prefix FROM ra WHERE prefix <> '') r JOIN uwc u ON u."user" = r."user" AND starts_with(u.word, r.prefix)) WHERE r <= {C.pool})""",
    f"""mine AS (SELECT a."user", a.w1, a.w2, a.prefix, rc.mode, rc.w FROM ra a JOIN rc ON rc.w1 = a.w1 AND rc.w2 = a.w2 AND rc.prefix = a.prefix
 UNION SELECT a."user", a.w1, a.w2, a.prefix, 'next_word', u.w FROM rua a JOIN ucr u ON u."user" = a."user" AND u.w1 = a.w1 AND u.w2 = a.w2 WHERE u.w NOT IN {SPECIAL}
 UNION SELECT a."user", a.w1, a.w2, a.prefix, 'completion', u.word FROM ra a JOIN upc u ON u."user" = a."user" AND u.prefix = a.prefix)""",
    f"ms AS ({S.score('mine', 3, 'f3', 'f2')})", f"mu AS ({S.user_score('ms')})",
    f"""lam AS (SELECT "user", {C.lambda_max}::DOUBLE * least(1.0::DOUBLE, sum(len(tokens))::DOUBLE / {C.growth_tokens}) AS lam FROM ret GROUP BY 1)""",
    "mf AS (SELECT mu.*, coalesce(lam, 0) * p_user + (1 - coalesce(lam, 0)) * p_stupid_backoff AS sc FROM mu LEFT JOIN lam USING (\"user\"))",
    f'mr AS (SELECT *, row_number() OVER (PARTITION BY "user", w1, w2, prefix ORDER BY {S.rk("sc")} DESC, w) AS r FROM mf)',
    select="""SELECT q.conv_id, q.turn, q.state, x.r AS rank, x.w AS word, round(x.sc, 9) AS score, CASE WHEN x.p_user > 0 THEN 'user' ELSE 'base' END AS source, x.mode
 FROM rq q JOIN mr x ON x."user" = q.conv_id AND x.w1 = q.w1 AND x.w2 = q.w2 AND x.prefix = q.prefix WHERE x.r <= 3""",
)

# tags: the shape tagger's tables follow those of the model


def _tagged(candidates: str, out: str) -> str:
    """out: candidates(w1, w2, w, p, ...) with tag, ctx_tag, known and pos."""
    return f"""{S.TOKS}, {S.SHAPE}, {S.TSPLIT},
{S.hmm_tables()},
{S.windows(candidates)},
tw AS (SELECT DISTINCT w AS word, false AS f FROM {candidates} UNION SELECT DISTINCT word, pos = 0 FROM wrows),
{S.emissions('tw')},
{_TYPICAL},
{S.viterbi('wrows', 'em AS (SELECT r.sid, r.pos, e.tag, e.lp FROM wrows r JOIN emis e ON e.word = r.word AND e.f = (r.pos = 0))')},
ct AS (SELECT k.w1, k.w2, l.tag AS ctx_tag FROM wkey k LEFT JOIN lastv l ON l.sid = k.sid AND len(k.win) > 0),
{out} AS (SELECT c.*, ty.tag, ct.ctx_tag, ty.known, CASE WHEN ct.ctx_tag IS NULL THEN i.lp ELSE t.lp END + CASE WHEN ty.known THEN 0 ELSE {C.unknown_tag_penalty} END AS pos
 FROM {candidates} c JOIN ty ON ty.word = c.w JOIN ct ON ct.w1 = c.w1 AND ct.w2 = c.w2 JOIN h_init i ON i.tag = ty.tag LEFT JOIN h_trans t ON t.prev = ct.ctx_tag AND t.tag = ty.tag)"""


_TYPICAL = """ty AS (SELECT word, tag, known FROM (SELECT e.word, e.tag, e.known, row_number() OVER (PARTITION BY e.word ORDER BY e.lp + ln(tc.cnt / dims.total) DESC, e.tag) AS r
  FROM emis e JOIN tc USING (tag) CROSS JOIN dims WHERE NOT e.f) WHERE r = 1)"""
_FINAL = f"CASE WHEN p > 0 THEN ln(p) ELSE {C.score_floor} END + {{}} * pos"


def _reranked(b, *cols):
    asked, once = _asked(b)
    p = _predictor(b, tagger=True)
    r = p.rank(p.scored(once)).select("user", "ctx", "prefix", big("rank"), F.col("shown").alias("word"), *cols, "mode", "tag")
    return _back(asked, r, "rank", "word", *[c for c in r.columns if c not in ("user", "ctx", "prefix", "rank", "word")])


RERANK = (
    *BOTH, _tagged("rc", "rg"),
    f"rr AS (SELECT *, row_number() OVER (PARTITION BY w1, w2, prefix ORDER BY round(fin, 9) DESC, w) AS r"
    f" FROM (SELECT *, {_FINAL.format(C.rerank_alpha)} AS fin FROM rg))"
)
add(
    "predict_reranked", lambda b: _reranked(b, r6("final", "score")), *RERANK, select=SHOWN.format(
        "x.w AS word, round(x.fin, 6) AS score, x.mode, x.tag", "rr"
    ), recursive=True,
)
add(
    "predict_explain", lambda b: _reranked(b, r6("base"), r6("pos"), r6("final", "total"), "ctx_tag", "known"), *RERANK,
    select=SHOWN.format(
        "x.w AS word, round(x.p, 6) AS base, round(x.pos, 6) AS pos, round(x.fin, 6) AS total, x.ctx_tag, x.known, x.mode, x.tag", "rr"
    ), recursive=True,
)

# --- evaluation over held-out text: requests by context


def _all_next(b, cfg=C):
    asked = predict.asked_positions(b.held)
    req = asked.select("ctx").distinct().select(
        F.struct("ctx").alias("req_id"), F.lit(None).cast("bigint").alias("user"), "ctx", F.lit("").alias("prefix")
    )
    p = _predictor(b, cfg=cfg)
    return p.rank(p.scored(req)).select(joined("ctx", "ctx"), big("rank"), "word", r6("score"))


NEXT = (
    S.SMALL, S.HELD, S.candidates("hp", C.pool), POOL,
    f"pn AS (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY {S.rk('p')} DESC, w) AS r FROM pool)"
)
_ASKN = f"an AS (SELECT w1, w2, w FROM hp WHERE w NOT IN {SPECIAL})"
_NX = "SELECT w1 || ' ' || w2 AS ctx, r AS rank, w AS word, round(p, 6) AS score FROM {} WHERE r <= 3 AND (w1, w2) IN (SELECT (w1, w2) FROM an)"
_HITS = ", ".join(f"round(avg((coalesce(r, 99) <= {k})::INT), 6) AS hit_{k}" for k in (1, 3, 5))
add("predict_next_word", _all_next, *NEXT, _ASKN, select=_NX.format("pn"))
add(
    "predict_no_punct", lambda b: _all_next(b, C.override(suggest_punctuation=False)), *NEXT, _ASKN,
    f"np AS (SELECT w1, w2, w, p, row_number() OVER (PARTITION BY w1, w2 ORDER BY {S.rk('p')} DESC, w) AS r FROM pn"
    f" WHERE NOT regexp_matches(w, {S.q(T.PUNCTUATION)}))",
    select=_NX.format("np"),
)
add(
    "hit_at_k_next_word", lambda b: _predictor(b).hit_at_k(predict.asked_positions(b.held)).select(
        "positions", *[r6(f"hit_{k}") for k in (1, 3, 5)]
    ), *NEXT, _ASKN,
    select=f"SELECT count(*) AS positions, {_HITS} FROM an LEFT JOIN pn ON pn.w1 = an.w1 AND pn.w2 = an.w2 AND pn.w = an.w",
)


def _all_complete(b):
    asked = predict.asked_positions(b.held, prefix_len=2)
    req = asked.select("ctx", "prefix").distinct().select(
        F.struct("ctx", "prefix").alias("req_id"), F.lit(None).cast("bigint").alias("user"), "ctx", "prefix"
    )
    p = _predictor(b)
    return p.rank(p.scored(req)).select(joined("ctx", "ctx"), "prefix", big("rank"), "word", r6("score"))


def _completed(asked: str, out: str) -> str:
    """The pool of each prefix with ranks r."""
    return f"{_completions(asked, out + '_s')},\n{out} AS (SELECT *, row_number() OVER (PARTITION BY w1, w2, prefix ORDER BY {S.rk('p')} DESC, w) AS r FROM {out}_s)"


COMP = (S.SMALL, S.HELD, K.LEX, K.PREF)
_A2 = f"ac AS (SELECT w1, w2, w, substring(w, 1, 2) AS prefix FROM hp WHERE w NOT IN {SPECIAL} AND length(w) > 2)"
_ON = "ON {0}.w1 = ac.w1 AND {0}.w2 = ac.w2 AND {0}.prefix = ac.prefix AND {0}.w = ac.w"
add(
    "predict_completion", _all_complete, *COMP, _A2, _completed("ac", "pc"),
    select="SELECT w1 || ' ' || w2 AS ctx, prefix, r AS rank, w AS word, round(p, 6) AS score FROM pc WHERE r <= 3"
)
add(
    "completion_hit_at_k", lambda b: _predictor(b).hit_at_k(predict.asked_positions(b.held, prefix_len=2)).select(
        "positions", *[r6(f"hit_{k}") for k in (1, 3, 5)]
    ),
    *COMP, _A2, _completed("ac", "pc"), select=f"SELECT count(*) AS positions, {_HITS} FROM ac LEFT JOIN pc {_ON.format('pc')}",
)
add(
    "keystroke_savings", lambda b: _predictor(b).keystroke_savings(
        predict.asked_positions(b.held).select("ctx", "target")
    ).select("words", "baseline", "cost", "accepted", r6("savings")), *COMP,
    f"""ak AS (SELECT w1, w2, w, n, substring(w, 1, i) AS prefix, i FROM (SELECT *, unnest(range(1, length(w))) AS i
 FROM (SELECT w1, w2, w, count(*) AS n FROM hp WHERE w NOT IN {SPECIAL} GROUP BY ALL)))""",
    _completed("ak", "pk"),
    "hitk AS (SELECT ak.w1, ak.w2, ak.w, min(i) AS i FROM ak JOIN pk ON pk.w1 = ak.w1 AND pk.w2 = ak.w2 AND pk.prefix = ak.prefix AND pk.w = ak.w"
    " WHERE r <= 3 GROUP BY ALL)",
    f"al AS (SELECT w1, w2, w, count(*) AS n FROM hp WHERE w NOT IN {SPECIAL} GROUP BY ALL)",
    "ks AS (SELECT n, length(al.w) + 1 AS whole, CASE WHEN i IS NOT NULL THEN i + 1 ELSE length(al.w) + 1 END AS keys, i IS NOT NULL AS hit FROM al"
    " LEFT JOIN hitk h ON h.w1 = al.w1 AND h.w2 = al.w2 AND h.w = al.w)",
    select="""SELECT sum(n)::BIGINT AS words, sum(n * whole)::BIGINT AS baseline, sum(n * keys)::BIGINT AS cost, sum(CASE WHEN hit THEN n ELSE 0 END)::BIGINT AS accepted,
 round(1 - sum(n * keys) / sum(n * whole), 6) AS savings FROM ks""",
)

# --- reranking by tags, over held-out text


def _arms(b, alphas, modes=("next_word", "completion")):
    """Hits by alpha and mode; the candidates of a mode are scored once for all alphas."""
    p, out = _predictor(b, tagger=True), None
    for mode in modes:
        rows = predict.asked_positions(b.held, prefix_len=2 if mode == "completion" else 0)
        r = p.hit_at_k(rows, alphas=alphas).select("alpha", F.lit(mode).alias("mode"), "positions", *[r6(f"hit_{k}") for k in (1, 3, 5)])
        out = r if out is None else out.unionByName(r)
    return out


def _ablation(b):
    """Without and with tags, and the difference."""
    arms = _arms(b, (0.0, C.rerank_alpha)).withColumn("arm", F.when(F.col("alpha") == 0, "off").otherwise("on")).drop("alpha")
    arms = bundle.materialize(arms)
    names = ["hit_1", "hit_3", "hit_5"]
    change = [F.round(F.max(F.when(F.col("arm") == "on", F.col(h))) - F.max(F.when(F.col("arm") == "off", F.col(h))), 6).alias(h) for h in names]
    delta = arms.groupBy("mode").agg(F.max("positions").alias("positions"), *change).withColumn("arm", F.lit("delta"))
    return arms.select("arm", "mode", "positions", *names).unionByName(delta)


#: hc(mode, w1, w2, prefix, w, p) candidates and ha(mode, w1, w2, prefix, w) asked places
HELD_BOTH = (
    S.SMALL, S.HELD, K.LEX, K.PREF, S.candidates("hp", C.pool), POOL, _A2, _completions("ac", "comp"),
    "hc AS (SELECT 'next_word' AS mode, w1, w2, '' AS prefix, w, p FROM pool UNION ALL SELECT 'completion', w1, w2, prefix, w, p FROM comp)",
    f"ha AS (SELECT 'next_word' AS mode, w1, w2, '' AS prefix, w FROM hp WHERE w NOT IN {SPECIAL} UNION ALL SELECT 'completion', w1, w2, prefix, w"
    f" FROM ac)",
    _tagged("hc", "hg"),
)


def _hits_sql(alphas) -> str:
    return f"""fa AS (SELECT *, {_FINAL.format('alpha')} AS fin FROM hg CROSS JOIN (SELECT unnest({list(alphas)}::DOUBLE[]) AS alpha)),
fr AS (SELECT alpha, mode, w1, w2, prefix, w, row_number() OVER (PARTITION BY alpha, mode, w1, w2, prefix ORDER BY round(fin, 9) DESC, w) AS r FROM fa),
hk AS (SELECT l.alpha, ha.mode, count(*) AS positions, {_HITS} FROM ha CROSS JOIN (SELECT unnest({list(alphas)}::DOUBLE[]) AS alpha) l
 LEFT JOIN fr ON fr.alpha = l.alpha AND fr.mode = ha.mode AND fr.w1 = ha.w1 AND fr.w2 = ha.w2 AND fr.prefix = ha.prefix AND fr.w = ha.w GROUP BY ALL)"""


_HD = ", ".join(f"round(b.hit_{k} - a.hit_{k}, 6)" for k in (1, 3, 5))
add(
    "rerank_ablation", _ablation, *HELD_BOTH, _hits_sql((0.0, C.rerank_alpha)),
    select=f"""SELECT CASE WHEN alpha = 0 THEN 'off' ELSE 'on' END AS arm, mode, positions, hit_1, hit_3, hit_5 FROM hk
 UNION ALL SELECT 'delta', a.mode, a.positions, {_HD} FROM hk a JOIN hk b USING (mode) WHERE a.alpha = 0 AND b.alpha > 0""", recursive=True,
)
add(
    "alpha_sweep", lambda b: _arms(b, ALPHAS), *HELD_BOTH, _hits_sql(ALPHAS), select="SELECT alpha, mode, positions, hit_1, hit_3, hit_5 FROM hk",
    recursive=True
)
_SHAPE_TABLES = f"{S.TOKS}, {S.SHAPE}, {S.TSPLIT},\n{S.hmm_tables()}"
_WORDS = f"lw AS (SELECT w AS word, false AS f FROM g1 WHERE w NOT IN {SPECIAL})"
add(
    "typical_tag", lambda b: _tags(b).typical_tags(b.lexicon.select("word")), S.LM, _WORDS, _SHAPE_TABLES, S.emissions("lw"), _TYPICAL, select="SELECT word, tag, known FROM ty",
)
add(
    "context_tag", lambda b: _tags(b).context_tags(b.contexts.select("ctx").distinct()).select(joined("ctx", "ctx"), "ctx_tag"),
    S.LM, S.HELD, _SHAPE_TABLES, S.windows("hp"), S.decoded("wrows"),
    select="SELECT k.w1 || ' ' || k.w2 AS ctx, l.tag AS ctx_tag FROM wkey k LEFT JOIN lastv l ON l.sid = k.sid AND len(k.win) > 0", recursive=True,
)


def _unknown_emissions(b):
    """The emissions of the held-out text's unseen words, one row a tag."""
    words = b.table("benchmark").select(F.col("item_id").alias("sid"), F.posexplode(T.tokenize(F.col("text"))).alias("pos", "word"))
    t = b.shape_tagger
    rows = t.with_emissions(words).where("NOT known").select("word", (F.col("pos") == 0).alias("is_first"), "emit").distinct()
    return rows.select("word", "is_first", F.posexplode("emit").alias("i", "lp")).select(
        "word", "is_first", F.get(t.names(), F.col("i")).alias("tag"), r6("lp")
    )


add(
    "hmm_unknown_emission", _unknown_emissions, S.sents(), _SHAPE_TABLES,
    f"bw AS (SELECT DISTINCT word, pos = 0 AS f FROM (SELECT generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS word"
    f" FROM (SELECT {S.toks('text')} AS t FROM benchmark)))",
    S.emissions("bw"), select="SELECT word, f AS is_first, tag, round(lp, 6) AS lp FROM emis WHERE NOT known",
)


def _tag_scores(b):
    p = _tags(b)
    tags = p.typical_tags(b.lexicon.select("word"))
    prev = b.spark.createDataFrame([(None,), *[(t,) for t in b.shape_tagger.tags]], "prev string")
    score = p.tag_score(F.col("tag"), F.col("prev"), F.col("known"))
    return tags.crossJoin(F.broadcast(prev)).select("word", "prev", F.round(score, 6).alias("score"))  # a row a tag


add(
    "tag_score", _tag_scores, S.LM, _WORDS, _SHAPE_TABLES, S.emissions("lw"), _TYPICAL,
    select=f"""SELECT word, pv.prev, round(CASE WHEN pv.prev IS NULL THEN i.lp ELSE t.lp END + CASE WHEN known THEN 0 ELSE {C.unknown_tag_penalty} END, 6) AS score
 FROM ty CROSS JOIN (SELECT tag AS prev FROM tc UNION ALL SELECT NULL) pv JOIN h_init i ON i.tag = ty.tag LEFT JOIN h_trans t ON t.prev = pv.prev AND t.tag = ty.tag""",
)


def _held_rows(b):
    return b.held.select("sid", F.posexplode("tokens").alias("pos", "word"))


def _windows(b):
    """How often the tag by a short window differs from that by the whole prefix, and from the finished sentence's; one forward pass a sentence."""
    t = _tags(b)
    names, best = t.tagger.names(), F.col("c")
    at = lambda x: F.get(names, (F.array_position(x, F.array_max(x)) - 1).cast("int"))
    prefix = t.tagger.trellis(_held_rows(b)).select(
        "sid", F.posexplode("trellis").alias("pos", "c")
    ).select("sid", "pos", at(best).alias("by_prefix"))
    whole = t.tagger.decode(_held_rows(b)).select("sid", F.posexplode("path").alias("pos", "by_sentence"))
    places = b.held.select("sid", "tokens", F.posexplode("tokens").alias("pos", "w")).where(F.col("pos") < F.size("tokens") - 1)
    places = bundle.materialize(
        places.select(
            "sid", "pos",
            F.slice("tokens", F.greatest(F.col("pos") - max(WINDOWS) + 2, F.lit(1)), F.least(F.col("pos") + 1, F.lit(max(WINDOWS)))).alias("ctx")
        ).join(prefix, ["sid", "pos"]).join(whole, ["sid", "pos"])
    )
    out = None
    for s in WINDOWS:
        short = F.slice("ctx", F.greatest(F.size("ctx") - s + 1, F.lit(1)), F.lit(s))
        rows = places.withColumn("ctx", short)
        rows = rows.join(t.context_tags(rows.select("ctx").distinct(), s), "ctx")
        share = lambda c: F.round(F.avg((F.col("ctx_tag") != F.col(c)).cast("double")), 6)
        r = rows.agg(
            F.lit(s).cast("bigint").alias("window"), F.count("*").alias("positions"), share("by_prefix").alias("vs_prefix"),
            share("by_sentence").alias("vs_sentence")
        )
        out = r if out is None else out.unionByName(r)
    return out


_HROWS = "hrows AS (SELECT sid, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS word FROM held)"
add(
    "tag_window_disagreement", _windows, S.LM, S.HELD, _SHAPE_TABLES, _HROWS, S.decoded("hrows"),
    f"""pl AS (SELECT size, h.sid, i AS pos, tokens[greatest(i + 2 - size, 1):i + 1] AS win
 FROM (SELECT sid, tokens, unnest(range(0, len(tokens) - 1)) AS i FROM held) h CROSS JOIN (SELECT unnest({list(WINDOWS)}) AS size))""",
    "wk AS (SELECT DISTINCT array_to_string(win, chr(1)) AS sid, win FROM pl)",
    "wrows AS (SELECT sid, generate_subscripts(win, 1) - 1 AS pos, unnest(win) AS word FROM wk)", S.decoded("wrows", "w"),
    "bp AS (SELECT sid, pos, tag FROM (SELECT sid, pos, tag, row_number() OVER (PARTITION BY sid, pos ORDER BY score DESC, tag) AS r FROM v)"
    " WHERE r = 1)",
    select="""SELECT size::BIGINT AS window, count(*) AS positions, round(avg((l.tag <> b.tag)::INT), 6) AS vs_prefix, round(avg((l.tag <> p.tag)::INT), 6) AS vs_sentence
 FROM pl JOIN lastvw l ON l.sid = array_to_string(pl.win, chr(1)) JOIN bp b ON b.sid = pl.sid AND b.pos = pl.pos JOIN path p ON p.sid = pl.sid AND p.pos = pl.pos GROUP BY size""", recursive=True,
)


def _guesses(b):
    """Scorable held-out tokens with the tag in context and the tag out of context."""
    p, rows = _tags(b), _held_rows(b)
    path = b.shape_tagger.decode(rows).select("sid", F.posexplode("path").alias("pos", "best"))
    rows = rows.where(~F.col("word").isin(C.bos, C.eos, C.unk))
    return rows.join(path, ["sid", "pos"]).join(p.typical_tags(rows.select("word").distinct()), "word")


def _agreement(b):
    hit = (F.col("best") == F.col("tag")).cast("double")
    known = F.coalesce(F.avg(F.when(F.col("known"), hit)), F.lit(0.0))
    return _guesses(b).agg(
        F.count("*").alias("tokens"), F.round(F.coalesce(F.avg(hit), F.lit(0.0)), 6).alias("agreement"), F.round(known, 6).alias("known_agreement"),
        F.count_if(~F.col("known")).alias("unknown_tokens")
    )


_GUESS = (S.LM, S.HELD, _SHAPE_TABLES, _HROWS, "gw AS (SELECT DISTINCT word, pos = 0 AS f FROM hrows UNION SELECT DISTINCT word, false FROM hrows)", S.emissions("gw"), _TYPICAL,
          S.viterbi("hrows", "em AS (SELECT r.sid, r.pos, e.tag, e.lp FROM hrows r JOIN emis e ON e.word = r.word AND e.f = (r.pos = 0))"),
          f"gu AS MATERIALIZED (SELECT p.tag AS best, ty.tag, ty.known FROM hrows h JOIN path p ON p.sid = h.sid AND p.pos = h.pos JOIN ty ON ty.word = h.word WHERE h.word NOT IN {SPECIAL})")
add(
    "typical_tag_agreement", _agreement, *_GUESS, recursive=True,
    select="""SELECT count(*) AS tokens, round(coalesce(avg((best = tag)::INT), 0), 6) AS agreement, round(coalesce(avg((best = tag)::INT) FILTER (known), 0), 6) AS known_agreement,
 count(*) FILTER (NOT known) AS unknown_tokens FROM gu""",
)
add(
    "typical_tag_confusions", lambda b: _guesses(b).where("best <> tag").groupBy(
        F.col("best").alias("in_context"), F.col("tag").alias("guess")
    ).agg(F.count("*").alias("cnt")).orderBy(F.col("cnt").desc(), "in_context", "guess").limit(10),
    *_GUESS, select="SELECT best AS in_context, tag AS guess, count(*) AS cnt FROM gu WHERE best <> tag GROUP BY ALL ORDER BY cnt DESC, in_context, guess LIMIT 10", recursive=True,
)

# --- saved artefacts and loading


def _folder(b) -> str:
    return f"{bundle.shared_dir(b.spark)}/saved-{uuid.uuid4().hex}"


def _text_files(b):
    """Benchmark texts written as files, loaded as a corpus of text files."""
    at = _folder(b)
    b.table("benchmark").select("item_id", "text").write.partitionBy("item_id").option("lineSep", "\x1e").text(at)
    return corpora.load_sentences(b.spark, at).select(
        "si", "sentence", F.size("tokens").cast("bigint").alias("n")
    ).withColumn("si", F.col("si").cast("bigint"))


add("load_text_files", _text_files, S.sents("benchmark", "item_id"), select="SELECT si::BIGINT AS si, sentence, len(tokens) AS n FROM sents")
add(
    "load_corpus_sentences", lambda b: corpora.load_sentences(
        b.spark, f"{b.dir}/no-such-corpus.parquet", limit=200, fallback=f"{b.dir}/documents.parquet"
    ).select("sid", joined("tokens")),
    S.sents(), select="SELECT sid, array_to_string(tokens, ' ') AS tokens FROM sents ORDER BY sid LIMIT 200",
)


def _load_tagged(b):
    """Tagged events written in two columns, read back, cleaned and counted: files have no sentence ids."""
    from .sources.conll import write_conll

    at = _folder(b)
    write_conll(b.tagged, at)
    rows = corpora.load_tagged(b.spark, at)
    return rows.groupBy("word", "tag").agg(
        F.count("*").alias("cnt"), F.count_distinct("sid").alias("sentences"), F.count_if(F.col("pos") == 0).alias("firsts")
    )


add(
    "load_tagged_sentences", _load_tagged, S.TAGGED,
    select="SELECT word, tag, count(*) AS cnt, count(DISTINCT sid) AS sentences, count(*) FILTER (pos = 0) AS firsts FROM tagged GROUP BY ALL"
)


def _corpus_back(b):
    at = _folder(b)
    bundle.save_corpus(b.corpus, at)
    back = bundle.load_corpus(b.spark, at)
    kept = back.vocab.where("in_vocab").agg(F.count("*").alias("vocab"))
    return back.sentences.groupBy("split").agg(
        F.count("*").alias("sentences"), F.sum(F.size("tokens")).alias("tokens")
    ).crossJoin(kept).crossJoin(back.truecase.agg(F.count("*").alias("truecase")))


add(
    "corpus_save_load", _corpus_back, S.sents(), S.CORPUS,
    select="""SELECT split, count(*) AS sentences, sum(len(tokens))::BIGINT AS tokens, (SELECT count(*) FROM kept) AS vocab,
 (SELECT count(DISTINCT lower(tok)) FROM (SELECT generate_subscripts(tokens, 1) AS i, unnest(tokens) AS tok FROM parted WHERE split = 'train') WHERE i > 1) AS truecase FROM corpus GROUP BY split""",
)


def _model_back(b):
    at = _folder(b)
    bundle.save_model(b.small, at)
    m = bundle.load_model(b.spark, at)
    return m.grams.select(F.col("k").cast("bigint").alias("k"), joined("ctx", "ctx"), "word", "cnt")


add(
    "model_save_load", _model_back, S.SMALL,
    select="SELECT 3::BIGINT AS k, w1 || ' ' || w2 AS ctx, w AS word, cnt FROM f3 UNION ALL SELECT 2, w2, w, cnt FROM f2 UNION ALL SELECT 1, '', w, cnt FROM g1"
)


def _tagger_back(b):
    at = _folder(b)
    bundle.save_tagger(b.tagger, at)
    return K._ev(hmm.evaluate(bundle.load_tagger(b.spark, at).predictions(b.tag_test)))


add("tagger_save_load", _tagger_back, S.HMM, S.decoded("te"), _preds(), select=K._EV, recursive=True)
add(
    "tagger_inspect", lambda b: b.spark.createDataFrame(
        [(k, float(v)) for k, v in b.tagger.inspect().items() if not isinstance(v, str)], "name string, value double"
    ), S.HMM,
    select=f"""SELECT unnest(['tags', 'words', 'sentences', 'tokens', 'k']) AS name, unnest([nt, nw, ns, total, {C.hmm_k}]::DOUBLE[]) AS value FROM dims""",
)

STATS = 'SELECT "user", tokens, sentences, vocabulary, round({0} * least(1.0, tokens / {1}.0), 6) AS weight FROM (SELECT "user", sum(len(tokens))::BIGINT AS tokens, count(*) AS sentences, len(list_distinct(flatten(list(tokens)))) AS vocabulary FROM {2} GROUP BY 1)'


def _profile_back(b):
    """Profiles with a cap of their own, saved, compacted to what is retained, and loaded with the saved settings."""
    at = _folder(b)
    store = bundle.ProfileStore(b.spark, at, C.override(profile_cap=K.USER_CAP, growth_tokens=50))
    store.observe(b.observed)
    store.compact()
    back = bundle.ProfileStore.load(b.spark, at)
    return profile.stats(back.observed(), back.cfg).select("user", "tokens", "sentences", "vocabulary", r6("weight"))


add("profile_save_load", _profile_back, K._US(K.USER_CAP), select=STATS.format(C.lambda_max, 50, "ret"))


def _profile_reset(b):
    """Profiles after all users with an even id asked to be forgotten and came back with their assistants' answers."""
    at = _folder(b)
    store = bundle.ProfileStore(b.spark, at)
    store.observe(b.observed)
    store.reset(b.observed.where("user % 2 = 0").select("user"))
    return profile.stats(store.observed()).select("user", "tokens", "sentences", "vocabulary", r6("weight"))


add(
    "profile_reset", _profile_reset, K._US(), 'odd AS (SELECT * FROM ret WHERE "user" % 2 = 1)',
    select=STATS.format(C.lambda_max, C.growth_tokens, "odd")
)


def _learned(b):
    """User turns are observed, then the answers that came back are learned; the grams of both."""
    store = bundle.ProfileStore(b.spark, _folder(b))
    store.observe(b.observed)
    texts = b.table("conversations").where("role = 'assistant'").select(
        F.col("conv_id").alias("user"), (F.col("turn") + 1_000_000).alias("seq"), "text"
    )
    _predictor(b).learn(store, texts)
    return profile.user_grams(store.retained()).where("k = 2").select("user", joined("ctx", "ctx"), "word", "cnt")


add(
    "predict_learn", _learned,
    K._US().replace("WHERE role = 'user'", "WHERE role IN ('user', 'assistant')").replace(
        "turn * 100000", "(turn + CASE role WHEN 'user' THEN 0 ELSE 1000000 END) * 100000"
    ).replace("SELECT conv_id, turn, ", "SELECT conv_id, turn, role, "),
    S.USER_GRAMS, select='SELECT "user", w2 AS ctx, w AS word, cnt FROM ug2',
)


def _loaded(b):
    """Model, corpus, profiles and tagger saved, a predictor loaded from them, and every user's turns answered by it."""
    at = _folder(b)
    bundle.save_model(b.small, f"{at}/model")
    p = bundle.load_predictor(b.spark, f"{at}/model")
    asked, once = _asked(b)
    r = p.rank(p.scored(once)).select("user", "ctx", "prefix", big("rank"), F.col("shown").alias("word"), r6("score"))
    return _back(asked, r, "rank", "word", "score")


add(
    "predict_from_paths", _loaded, *BOTH, f"rr AS (SELECT *, row_number() OVER (PARTITION BY w1, w2, prefix ORDER BY {S.rk('p')} DESC, w) AS r"
    " FROM rc)",
    select=SHOWN.format("x.w AS word, round(x.p, 6) AS score", "rr"),
)
