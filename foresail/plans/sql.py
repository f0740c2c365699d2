"""DuckDB SQL for the catalog: chains of common table expressions, written apart from the Spark plans but for shared patterns."""

from __future__ import annotations

from ..config import DEFAULT as C
from ..functions import text as T


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def emails(c: str) -> str:
    return f"regexp_replace({c}, {q(T.EMAIL)}, ' ', 'g')"


def urls(c: str) -> str:
    return f"regexp_replace({c}, {q(T.URL)}, ' ', 'gi')"


def clean(c: str) -> str:
    c = urls(emails(f"regexp_replace({c}, {q(T.CONTROL)}, ' ', 'g')"))
    return f"trim(regexp_replace(translate({c}, {q(T.CURLY)}, {q(T.STRAIGHT)}), {q(T.SPACE)}, ' ', 'g'))"


def pieces(c: str) -> str:
    return f"list_filter(list_transform(string_split(regexp_replace({c}, {q(T.SENTENCE_END)}, '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


def toks(c: str) -> str:
    for p in T.CONTRACTIONS:
        c = f"regexp_replace({c}, {q(p)}, '\\1 \\2', 'gi')"
    return f"regexp_extract_all({c}, {q(T.TOKEN)})"


def sents(table: str = "documents", key: str = "doc_id", name: str = "sents") -> str:
    return f"""{name}_l AS (SELECT {key} AS doc_id, {pieces(clean('nfc_normalize(text)'))} AS l FROM {table}),
{name}_s AS (SELECT doc_id, generate_subscripts(l, 1) - 1 AS si, unnest(l) AS sentence FROM {name}_l),
{name} AS (SELECT doc_id * 1000000 + si AS sid, doc_id, si, sentence, {toks('sentence')} AS tokens FROM {name}_s WHERE len({toks('sentence')}) > 0)"""


TOKS = "toks AS (SELECT sid, generate_subscripts(tokens, 1) - 1 AS pos, unnest(tokens) AS tok FROM sents)"
VOCAB = f"""vocab AS (SELECT lower(tok) AS word, count(*) AS cnt, min({{'s': sid, 'p': pos}}) AS fs FROM toks GROUP BY 1)"""


def split_case(table: str, parts) -> str:
    cuts, cut = [], "0"
    for name, share in parts[:-1]:
        cut += f" + floor(n * {share})"
        cuts.append(f"WHEN r <= {cut} THEN '{name}'")
    return f"""(SELECT * EXCLUDE (r, n), CASE {' '.join(cuts)} ELSE '{parts[-1][0]}' END AS split FROM
 (SELECT *, row_number() OVER (ORDER BY md5('{C.seed}:' || sid)) AS r, count(*) OVER () AS n FROM {table}))"""


THREE = (("train", C.train), ("dev", C.dev), ("test", C.test))
CORPUS = f"""long_s AS (SELECT * FROM sents WHERE len(tokens) >= {C.min_sentence_tokens}),
parted AS (SELECT * FROM {split_case('long_s', THREE)}),
ptoks AS (SELECT sid, split, generate_subscripts(tokens, 1) - 1 AS pos, lower(unnest(tokens)) AS word FROM parted),
tvocab AS (SELECT word, count(*) AS cnt, min({{'s': sid, 'p': pos}}) AS fs FROM ptoks WHERE split = 'train' GROUP BY 1),
kept AS (SELECT word FROM tvocab WHERE cnt >= {C.min_freq} ORDER BY cnt DESC, fs LIMIT {C.max_vocab}),
corpus AS (SELECT sid, split, list(coalesce(k.word, '{C.unk}') ORDER BY pos) AS tokens FROM ptoks p LEFT JOIN kept k ON p.word = k.word GROUP BY sid, split)"""


def places(source: str, name: str) -> str:
    return f"""{name} AS (SELECT sid, i - 3 AS pos, p[i - 2] AS w1, p[i - 1] AS w2, p[i] AS w FROM
 (SELECT sid, p, unnest(range(3, len(p) + 1)) AS i FROM (SELECT sid, ['<s>', '<s>'] || tokens || ['</s>'] AS p FROM {source})))"""


GRAMS = f"""{places("(SELECT * FROM corpus WHERE split = 'train')", 'tp')},
g3 AS (SELECT w1, w2, w, count(*) AS cnt, min({{'s': sid, 'p': pos}}) AS fs FROM tp GROUP BY ALL),
g2 AS (SELECT w2, w, count(*) AS cnt, min({{'s': sid, 'p': pos}}) AS fs FROM tp GROUP BY ALL),
g1 AS (SELECT w, count(*) AS cnt, min({{'s': sid, 'p': pos}}) AS fs FROM tp GROUP BY ALL)"""

PRUNED = f"""f3 AS (SELECT w1, w2, w, cnt, fs FROM (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY cnt DESC, fs) AS r FROM g3 WHERE cnt >= {C.prune_min_count}) WHERE r <= {C.prune_max_continuations}),
f2 AS (SELECT w2, w, cnt, fs FROM (SELECT *, row_number() OVER (PARTITION BY w2 ORDER BY cnt DESC, fs) AS r FROM g2 WHERE cnt >= {C.prune_min_count}) WHERE r <= {C.prune_max_continuations})"""


def derived(g3: str = "g3", g2: str = "g2") -> str:
    return f"""t3 AS (SELECT w1, w2, sum(cnt) AS t, count(*) AS y FROM {g3} GROUP BY ALL),
t2 AS (SELECT w2, sum(cnt) AS t, count(*) AS y FROM {g2} GROUP BY ALL),
m2 AS (SELECT w2, w, count(*) AS cnt FROM {g3} GROUP BY ALL),
u2 AS (SELECT w2, sum(cnt) AS t, count(*) AS y FROM m2 GROUP BY ALL),
m1 AS (SELECT w, count(*) AS cnt FROM {g2} GROUP BY ALL),
one AS (SELECT (SELECT sum(cnt) FROM g1) AS t1, (SELECT count(*) FROM g1) AS y1, (SELECT count(*) FROM g1) AS v1, (SELECT count(*) + 1 FROM g1) AS v3, (SELECT sum(cnt) FROM m1) AS u1, (SELECT count(*) FROM m1) AS z1)"""


def score(asked: str, n: int = 3, g3: str = "g3", g2: str = "g2") -> str:
    """SELECT asked.*, p_mle, p_laplace, p_stupid_backoff, p_kneser_ney; asked has w1, w2, w."""
    d, a, k = C.discount, C.backoff_alpha, C.add_k
    v = "v1" if n == 1 else "v3"
    top = {3: ("a3.cnt", "t3.t", "t3.y"), 2: ("a2.cnt", "t2.t", "t2.y"), 1: ("a1.cnt", "t1", "y1")}[n]
    mle = f"coalesce({top[0]}, 0)::DOUBLE / nullif({top[1]}, 0)"
    sb = f"CASE WHEN a1.cnt > 0 THEN {a ** (n - 1)} * a1.cnt / t1 ELSE {a ** (n - 1)} / (t1 + {v}) END"
    if n >= 2:
        sb = f"CASE WHEN a2.cnt > 0 THEN {a ** (n - 2)} * a2.cnt / t2.t ELSE {sb} END"
    if n >= 3:
        sb = f"CASE WHEN a3.cnt > 0 THEN 1.0 * a3.cnt / t3.t ELSE {sb} END"
    low = f"(greatest(coalesce(b1.cnt, 0) - {d}, 0) / u1 + ({d} * z1 / u1) / {v})"
    if n == 1:
        kn = f"(greatest(coalesce(a1.cnt, 0) - {d}, 0) / t1 + ({d} * y1 / t1) / {v})"
    elif n == 2:
        kn = f"CASE WHEN t2.t > 0 THEN greatest(coalesce(a2.cnt, 0) - {d}, 0) / t2.t + ({d} * t2.y / t2.t) * {low} ELSE {low} END"
    else:
        mid = f"CASE WHEN u2.t > 0 THEN greatest(coalesce(b2.cnt, 0) - {d}, 0) / u2.t + ({d} * u2.y / u2.t) * {low} ELSE {low} END"
        kn = f"CASE WHEN t3.t > 0 THEN greatest(coalesce(a3.cnt, 0) - {d}, 0) / t3.t + ({d} * t3.y / t3.t) * ({mid}) ELSE {mid} END"
    return f"""SELECT x.*, coalesce({mle}, 0.0) AS p_mle, (coalesce({top[0]}, 0) + {k}) / (coalesce({top[1]}, 0) + {k} * {v}) AS p_laplace, {sb} AS p_stupid_backoff, {kn} AS p_kneser_ney
FROM (SELECT s.*, CASE WHEN s.w IN (SELECT w FROM g1) OR s.w = '<s>' THEN s.w ELSE '{C.unk}' END AS ww FROM {asked} s) x CROSS JOIN one
LEFT JOIN {g3} a3 ON a3.w1 = x.w1 AND a3.w2 = x.w2 AND a3.w = x.ww LEFT JOIN t3 ON t3.w1 = x.w1 AND t3.w2 = x.w2
LEFT JOIN {g2} a2 ON a2.w2 = x.w2 AND a2.w = x.ww LEFT JOIN t2 ON t2.w2 = x.w2 LEFT JOIN g1 a1 ON a1.w = x.ww
LEFT JOIN m2 b2 ON b2.w2 = x.w2 AND b2.w = x.ww LEFT JOIN u2 ON u2.w2 = x.w2 LEFT JOIN m1 b1 ON b1.w = x.ww"""


LM = f"{sents()},\n{CORPUS},\n{GRAMS}"
MODEL = f"{LM},\n{derived()}"
SMALL = f"{LM},\n{PRUNED},\n{derived('f3', 'f2')}"

#: held-out text: sentences of benchmark with the model's unknown word
HELD = f"""{sents('benchmark', 'item_id', 'hs')},
ht AS (SELECT sid, generate_subscripts(tokens, 1) - 1 AS pos, lower(unnest(tokens)) AS word FROM hs),
held AS (SELECT sid, list(coalesce(k.word, '{C.unk}') ORDER BY pos) AS tokens FROM ht LEFT JOIN kept k ON ht.word = k.word GROUP BY sid),
{places('held', 'hp')}"""


def rk(p: str) -> str:
    return f"CASE WHEN {p} > 0 THEN round(ln({p}), 9) ELSE -1e300 END"


def candidates(contexts: str, k: int, g3: str = "f3", g2: str = "f2") -> str:
    """cand(w1, w2, w, score): quota 5k in order of appearance, scored by stupid backoff."""
    return f"""top500 AS (SELECT w, cnt, fs FROM (SELECT * FROM g1 ORDER BY cnt DESC, fs LIMIT 500) WHERE w NOT IN ('<s>', '{C.unk}')),
cw AS (SELECT DISTINCT w1, w2 FROM {contexts}),
call AS (SELECT c.w1, c.w2, g.w, 0 AS prio, 0 AS neg, g.fs FROM cw c JOIN {g3} g ON g.w1 = c.w1 AND g.w2 = c.w2
 UNION ALL SELECT c.w1, c.w2, g.w, 1, 0, g.fs FROM cw c JOIN {g2} g ON g.w2 = c.w2
 UNION ALL SELECT c.w1, c.w2, g.w, 2, -g.cnt, g.fs FROM cw c CROSS JOIN top500 g),
cmin AS (SELECT w1, w2, w, min({{'a': prio, 'b': neg, 'c': fs}}) AS o FROM call WHERE w NOT IN ('<s>', '{C.unk}') GROUP BY ALL),
cq AS (SELECT w1, w2, w FROM (SELECT *, row_number() OVER (PARTITION BY w1, w2 ORDER BY o) AS r FROM cmin) WHERE r <= {5 * k}),
cand AS ({score('cq', 3, g3, g2)})"""


# --- tagged events: a sentence is a user's week

TAGGED = """ev AS (SELECT user_id * 1000 + CAST(date_diff('day', DATE '1970-01-05', CAST(date_trunc('week', ts) AS DATE)) // 7 AS BIGINT) % 1000 AS sid, ts, event_id, event_type AS tag, 'v' || CAST(CAST(floor(value / 25) AS BIGINT) AS VARCHAR) AS word FROM events),
tagged AS (SELECT sid, row_number() OVER (PARTITION BY sid ORDER BY ts, event_id) - 1 AS pos, word, tag FROM ev)"""
TWO = (("train", 0.8), ("test", 0.2))
TSPLIT = f"""tsid AS (SELECT DISTINCT sid FROM tagged),
tsplit AS (SELECT * FROM {split_case('tsid', TWO)}),
tr AS (SELECT t.* FROM tagged t JOIN tsplit USING (sid) WHERE split = 'train'),
te AS (SELECT t.* FROM tagged t JOIN tsplit USING (sid) WHERE split = 'test')"""
def hmm_tables(k: float = C.hmm_k) -> str:
    """Counts of tr(sid, pos, word, tag) and the smoothed parameters from them."""
    return f"""trl AS (SELECT *, lag(tag) OVER (PARTITION BY sid ORDER BY pos) AS prev, lead(tag) OVER (PARTITION BY sid ORDER BY pos) AS nxt FROM tr),
tc AS (SELECT tag, count(*) AS cnt, count(*) FILTER (prev IS NULL) AS starts, count(*) FILTER (nxt IS NULL) AS finals FROM trl GROUP BY tag),
dims AS (SELECT count(*) AS nt, sum(starts) AS ns, (SELECT count(DISTINCT word) FROM tr) AS nw, sum(cnt) AS total FROM tc),
trc AS (SELECT prev, tag, count(*) AS cnt FROM trl WHERE prev IS NOT NULL GROUP BY ALL),
h_init AS (SELECT tag, ln(starts + {k}) - ln(ns + {k} * nt) AS lp FROM tc, dims),
h_trans AS (SELECT a.tag AS prev, b.tag AS tag, ln(coalesce(c.cnt, 0) + {k}) - ln(a.cnt + {k} * (nt + 1)) AS lp FROM tc a CROSS JOIN tc b CROSS JOIN dims LEFT JOIN trc c ON c.prev = a.tag AND c.tag = b.tag),
h_final AS (SELECT tag, ln(finals + {k}) - ln(cnt + {k} * (nt + 1)) AS lp FROM tc, dims),
emc AS (SELECT word, tag, count(*) AS cnt FROM tr GROUP BY ALL),
wds AS (SELECT DISTINCT word FROM tr),
h_emit AS (SELECT w.word, t.tag, ln(coalesce(e.cnt, 0) + {k}) - ln(t.cnt + {k} * (nw + 1)) AS lp FROM wds w CROSS JOIN tc t CROSS JOIN dims LEFT JOIN emc e ON e.word = w.word AND e.tag = t.tag),
h_lap AS (SELECT tag, ln({k}) - ln(cnt + {k} * (nw + 1)) AS lp FROM tc, dims),
once AS (SELECT word FROM emc GROUP BY word HAVING sum(cnt) = 1),
hx AS (SELECT tag, count(*) AS h FROM emc WHERE word IN (SELECT word FROM once) GROUP BY tag),
hxs AS (SELECT coalesce(sum(h), 0) AS s FROM hx),
h_hap AS (SELECT t.tag, CASE WHEN s = 0 THEN l.lp ELSE ln((coalesce(h, 0) + {k}) / (s + {k} * nt)) - ln(t.cnt / total) END AS lp FROM tc t CROSS JOIN dims CROSS JOIN hxs JOIN h_lap l USING (tag) LEFT JOIN hx USING (tag))"""


HMM = f"{TAGGED}, {TSPLIT},\n{hmm_tables()}"


#: emissions of rows by known words and the prior alone
PLAIN_EMISSIONS = """em AS (SELECT r.sid, r.pos, t.tag, coalesce(e.lp, h.lp) AS lp FROM {rows} r CROSS JOIN tc t JOIN h_hap h ON h.tag = t.tag
 LEFT JOIN h_emit e ON e.word = r.word AND e.tag = t.tag)"""


def viterbi(rows: str, em: str | None = None, n: str = "", key: str = "sid") -> str:
    """v(sid, pos, tag, score, bp) by recursion, last column lastv, fin, and path; to be put after WITH RECURSIVE."""
    em = em or PLAIN_EMISSIONS.format(rows=rows)
    by = f"PARTITION BY v{n}.{key} ORDER BY v{n}.score + f.lp DESC, v{n}.tag"
    return f"""{em},
v{n} AS (SELECT em{n}.{key}, em{n}.pos, em{n}.tag, i.lp + em{n}.lp AS score, CAST(NULL AS VARCHAR) AS bp FROM em{n} JOIN h_init i USING (tag) WHERE em{n}.pos = 0
 UNION ALL SELECT {key}, pos, tag, score, bp FROM (SELECT em{n}.{key}, em{n}.pos, em{n}.tag, v{n}.score + t.lp + em{n}.lp AS score, v{n}.tag AS bp,
   row_number() OVER (PARTITION BY em{n}.{key}, em{n}.tag ORDER BY v{n}.score + t.lp DESC, v{n}.tag) AS r
  FROM v{n} JOIN h_trans t ON t.prev = v{n}.tag JOIN em{n} ON em{n}.{key} = v{n}.{key} AND em{n}.pos = v{n}.pos + 1 AND em{n}.tag = t.tag) WHERE r = 1),
lastpos{n} AS (SELECT {key}, max(pos) AS pos FROM {rows} GROUP BY {key}),
lastv{n} AS (SELECT {key}, tag FROM (SELECT v{n}.{key}, v{n}.tag, row_number() OVER (PARTITION BY v{n}.{key} ORDER BY v{n}.score DESC, v{n}.tag) AS r
  FROM v{n} JOIN lastpos{n} l ON l.{key} = v{n}.{key} AND l.pos = v{n}.pos) WHERE r = 1),
fin{n} AS (SELECT {key}, pos, tag, score FROM (SELECT v{n}.{key}, v{n}.pos, v{n}.tag, v{n}.score + f.lp AS score, row_number() OVER ({by}) AS r
  FROM v{n} JOIN lastpos{n} l ON l.{key} = v{n}.{key} AND l.pos = v{n}.pos JOIN h_final f ON f.tag = v{n}.tag) WHERE r = 1),
path{n} AS (SELECT {key}, pos, tag FROM fin{n} UNION ALL SELECT p.{key}, p.pos - 1, v{n}.bp
  FROM path{n} p JOIN v{n} ON v{n}.{key} = p.{key} AND v{n}.pos = p.pos AND v{n}.tag = p.tag WHERE p.pos > 0)"""


def suffix_case(rules, tags: bool, w: str) -> str:
    """The first of the longest suffixes, or the tags it names."""
    rows = "".join(
        f" WHEN ends_with({w}, {q(s)}) AND length({w}) >= {len(s) + 2} THEN {q(' '.join(t)) if tags else q(s)}" for s, t in T.by_length(rules)
    )
    return f"CASE{rows}{' ELSE ' + q('') if tags else ''} END"


#: names of tags that the shape of a word w suggests, f: whether it is a sentence's first
CANDIDATE_TAGS = f"""CASE WHEN NOT regexp_matches(w, '[\\p{{L}}\\p{{N}}]') THEN {q(' '.join(T.PUNCT_TAGS))}
 WHEN regexp_matches(w, '\\p{{Nd}}') THEN {q(' '.join(T.NUM_TAGS))}
 WHEN regexp_matches(w, '[\\x{{0900}}-\\x{{097f}}]') THEN {suffix_case(T.DEVANAGARI_RULES, True, 'w')}
 WHEN NOT f AND regexp_matches(w, '^\\p{{Lu}}') THEN {q(' '.join(T.PROPER_TAGS))}
 ELSE {suffix_case(T.SUFFIX_RULES, True, 'lower(w)')} END"""


def emissions(words: str, strategy: str = "suffix", prior: str = "hapax", n: str = "") -> str:
    """emis(word, f, tag, lp, known) of words(word, f): exact form, lower-case form, else the unseen-word model."""
    named = {"suffix": f"string_split({CANDIDATE_TAGS}, ' ')", "uniform": "[]::VARCHAR[]",
             "most_frequent_tag": "[(SELECT tag FROM (SELECT tag, count(*) AS c, min({'s': sid, 'p': pos}) AS fs FROM tr GROUP BY tag ORDER BY c DESC, fs LIMIT 1))]"}[strategy]
    return f"""xc{n} AS (SELECT w, f, {named} AS tags FROM (SELECT DISTINCT word AS w, f FROM {words})),
xh{n} AS (SELECT x.w AS word, x.f, t.tag, list_contains(x.tags, t.tag) AS hit, count(*) FILTER (list_contains(x.tags, t.tag)) OVER (PARTITION BY x.w, x.f) AS nh
 FROM xc{n} x CROSS JOIN tc t),
emis{n} AS (SELECT x.word, x.f, x.tag, coalesce(e.lp, l.lp, p.lp + CASE WHEN nh = 0 THEN 0 ELSE ln(0.1 + CASE WHEN hit THEN 0.9 / nh ELSE 0 END) END) AS lp,
  coalesce(e.lp, l.lp) IS NOT NULL AS known
 FROM xh{n} x JOIN {'h_hap' if prior == 'hapax' else 'h_lap'} p ON p.tag = x.tag
 LEFT JOIN h_emit e ON e.word = x.word AND e.tag = x.tag LEFT JOIN h_emit l ON l.word = lower(x.word) AND l.tag = x.tag)"""


def decoded(rows: str, n: str = "", key: str = "sid", **how) -> str:
    """Viterbi of rows(key, pos, word) with the unseen-word model."""
    em = f"em{n} AS (SELECT r.{key}, r.pos, e.tag, e.lp FROM {rows} r JOIN emis{n} e ON e.word = r.word AND e.f = (r.pos = 0))"
    return f"""ew{n} AS (SELECT DISTINCT word, pos = 0 AS f FROM {rows}),
{emissions(f'ew{n}', n=n, **how)},
{viterbi(rows, em, n, key)}"""


def decoded_lists(rows: str, n: str = "", key: str = "sid", **how) -> str:
    """path(key, pos, tag) as decoded() has it, with a sentence's emissions and pointers as lists of one row: for many long sentences."""
    return f"""ew{n} AS (SELECT DISTINCT word, pos = 0 AS f FROM {rows}),
{emissions(f'ew{n}', n=n, **how)},
vt{n} AS (SELECT (SELECT list(tag ORDER BY tag) FROM tc) AS tags, (SELECT count(*) FROM tc) AS nt, (SELECT list(lp ORDER BY tag) FROM h_init) AS a,
 (SELECT list(lp ORDER BY tag, prev) FROM h_trans) AS m, (SELECT list(lp ORDER BY tag) FROM h_final) AS z),
ve{n} AS (SELECT {key}, list(x ORDER BY pos) AS e FROM (SELECT r.{key}, r.pos, list(e.lp ORDER BY e.tag) AS x FROM {rows} r
 JOIN emis{n} e ON e.word = r.word AND e.f = (r.pos = 0) GROUP BY ALL) GROUP BY {key}),
vv{n} AS (SELECT {key}, e, 1::BIGINT AS p, list_transform(a, lambda x, j: x + e[1][j]) AS s, []::BIGINT[][] AS b FROM ve{n}, vt{n}
 UNION ALL SELECT {key}, e, p + 1, list_transform(w, lambda x, j: list_max(x) + e[p + 1][j]), list_append(b, list_transform(w, lambda x: list_position(x, list_max(x))::BIGINT))
  FROM (SELECT v.*, list_transform(range(0, nt), lambda j: list_transform(s, lambda y, i: y + m[j * nt + i])) AS w FROM vv{n} v, vt{n} WHERE p < len(e))),
vz{n} AS (SELECT {key}, b, p, list_transform(s, lambda x, j: x + z[j]) AS s FROM vv{n}, vt{n} WHERE p = len(e)),
vb{n} AS (SELECT {key}, b, p, list_position(s, list_max(s))::BIGINT AS k FROM vz{n} UNION ALL SELECT {key}, b, p - 1, b[p - 1][k] FROM vb{n} WHERE p > 1),
path{n} AS (SELECT {key}, p - 1 AS pos, tags[k] AS tag FROM vb{n}, vt{n})"""


def windows(contexts: str, size: int = C.tag_window) -> str:
    """wrows(sid, pos, word) and wkey(w1, w2, sid) of contexts(w1, w2): the last tokens that are no start mark."""
    return f"""wkey AS (SELECT DISTINCT w1, w2, list_filter([w1, w2], lambda x: x <> '<s>')[-{size}:] AS win, array_to_string(list_filter([w1, w2], lambda x: x <> '<s>')[-{size}:], chr(1)) AS sid FROM {contexts}),
wrows AS (SELECT DISTINCT sid, generate_subscripts(win, 1) - 1 AS pos, unnest(win) AS word FROM wkey WHERE len(win) > 0)"""


#: text tagged by the shape of its words
SHAPE = f"""tagged AS (SELECT sid, pos, tok AS word, CASE WHEN NOT regexp_matches(tok, '[\\p{{L}}\\p{{N}}]') THEN '.' WHEN regexp_matches(tok, '\\p{{Nd}}') THEN 'NUM' WHEN ends_with(tok, 'ly') THEN 'ADV' WHEN ends_with(tok, 'ing') OR ends_with(tok, 'ed') THEN 'VERB' WHEN length(tok) % 3 = 0 THEN 'ADJ' ELSE 'NOUN' END AS tag FROM toks)"""
SHAPED = f"{sents()}, {TOKS},\n{SHAPE}"

#: user turns: conversations of one id are a user, its turns arrive in order
USERS = f"""us_l AS (SELECT conv_id, turn, {pieces(clean('nfc_normalize(text)'))} AS l FROM conversations WHERE role = 'user'),
us_s AS (SELECT conv_id, turn, generate_subscripts(l, 1) - 1 AS si, unnest(l) AS sentence FROM us_l),
obs AS (SELECT conv_id AS "user", turn * 100000 + si AS seq, list_transform({toks('sentence')}, lambda x: lower(x)) AS tokens FROM us_s WHERE len({toks('sentence')}) > 0),
ret AS (SELECT "user", seq, tokens FROM (SELECT *, sum(len(tokens)) OVER (PARTITION BY "user" ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS s FROM obs) WHERE s <= CAPPED)"""
USER_GRAMS = """up AS (SELECT "user", seq, p, unnest(range(3, len(p) + 1)) AS i FROM (SELECT "user", seq, ['<s>', '<s>'] || tokens || ['</s>'] AS p FROM ret)),
ug3 AS (SELECT "user", p[i-2] AS w1, p[i-1] AS w2, p[i] AS w, count(*) AS cnt FROM up GROUP BY ALL),
ug2 AS (SELECT "user", p[i-1] AS w2, p[i] AS w, count(*) AS cnt FROM up GROUP BY ALL),
ug1 AS (SELECT "user", p[i] AS w, count(*) AS cnt FROM up GROUP BY ALL)"""


def user_score(asked: str) -> str:
    a = C.backoff_alpha
    return f"""SELECT x.*, CASE WHEN a3.cnt > 0 THEN 1.0 * a3.cnt / b3.t WHEN a2.cnt > 0 THEN {a} * a2.cnt / b2.t WHEN a1.cnt > 0 THEN {a * a} * a1.cnt / b1.t ELSE 0.0 END AS p_user
FROM {asked} x LEFT JOIN ug3 a3 ON a3."user" = x."user" AND a3.w1 = x.w1 AND a3.w2 = x.w2 AND a3.w = x.w
LEFT JOIN (SELECT "user", w1, w2, sum(cnt) AS t FROM ug3 GROUP BY ALL) b3 ON b3."user" = x."user" AND b3.w1 = x.w1 AND b3.w2 = x.w2
LEFT JOIN ug2 a2 ON a2."user" = x."user" AND a2.w2 = x.w2 AND a2.w = x.w LEFT JOIN (SELECT "user", w2, sum(cnt) AS t FROM ug2 GROUP BY ALL) b2 ON b2."user" = x."user" AND b2.w2 = x.w2
LEFT JOIN ug1 a1 ON a1."user" = x."user" AND a1.w = x.w LEFT JOIN (SELECT "user", sum(cnt) AS t FROM ug1 GROUP BY ALL) b1 ON b1."user" = x."user\""""


def user_candidates(asked: str, k: int) -> str:
    """ucr("user", w1, w2, w, p_user, r): the k best of all words the user wrote after some suffix of the context."""
    return f"""ucw AS (SELECT a."user", a.w1, a.w2, g.w FROM {asked} a JOIN ug3 g ON g."user" = a."user" AND g.w1 = a.w1 AND g.w2 = a.w2
 UNION SELECT a."user", a.w1, a.w2, g.w FROM {asked} a JOIN ug2 g ON g."user" = a."user" AND g.w2 = a.w2
 UNION SELECT a."user", a.w1, a.w2, g.w FROM {asked} a JOIN ug1 g ON g."user" = a."user"),
ucs AS ({user_score('ucw')}),
ucr AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY "user", w1, w2 ORDER BY {rk('p_user')} DESC, w) AS r FROM ucs WHERE w NOT IN ('<s>', '</s>')) WHERE r <= {k})"""
