"""MinHash near-duplicates with tensored banding and verification on full shingle sets.

Texts are split into words, A-Z lower-cased, and a document's set has its distinct five-word shingles as 64-bit hashes. Documents with equal
sets collapse into one class first. Each class has two collections of ``BANDS`` band keys of ``ROWS`` minhashes; the tables
are all pairs (i, j) of a key of the first collection with one of the second, so BANDS * BANDS tables need only
2 * BANDS * ROWS minhashes. Two classes are candidates if they meet in a table, agree on at least ``LEAST`` of the minhashes, and their sizes
allow the similarity. Tables are built in two steps: classes meet by a key of the first collection, which drops those that meet nobody, and
within such a bucket by the keys of the second.

Verification compares full sets. First each class is compared with its best candidate in each bucket, and components are formed. Then
only candidates in different components are left: each bucket's members that have some are compared exactly, in blocks, and
give one link for each two components that meet. So a bucket of thousands of copies of one text costs one comparison a member, and no
candidate is left out that could join two components. Components come from label propagation with pointer jumping over the verified links.

At a similarity of exactly 0.75 a pair meets in no table with a probability of about 1e-4 (at 0.8, 4e-6) and agrees on too few of 108 minhashes,
where 81 are expected, with one of about 2e-5.

Null or empty texts have no shingles, link with nothing, and are kept. Texts of fewer than five words have one shingle, the whole sequence.
Repeated ids: rows stand for themselves, and the smallest id of a component names it. A null id is never the smallest unless alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, join_few, join_many, pieces

SHINGLE = 5
ROWS = 3
BANDS = 18
LEAST = 62
PERCENT = 75
_P = np.uint64(0x9E3779B97F4A7C15)
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def _mix64(x: np.ndarray) -> np.ndarray:
    """A finalizer that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_IN_WORD = np.ones(256, bool)
_IN_WORD[[0x20, *range(0x09, 0x0E)]] = False
_OF_BYTE = _mix64(np.arange(1, 257, dtype=np.uint64) * _P)
_OF_PLACE = _mix64(np.arange(5001, 5001 + 4096, dtype=np.uint64) * _P) | np.uint64(1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word: the sum of a random number by byte times one by place in the word, mixed with the length."""
    b = np.frombuffer(data, np.uint8)
    inside = _IN_WORD[b]
    at = np.flatnonzero(inside)
    if not len(at):
        return np.empty(0, np.uint64)
    starts = np.flatnonzero(np.diff(at, prepend=at[0] - 2) > 1)
    lengths = np.diff(starts, append=len(at))
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    longest = int(lengths.max())
    of_place = _OF_PLACE if longest <= len(_OF_PLACE) else _mix64(np.arange(5001, 5001 + longest, dtype=np.uint64) * _P) | np.uint64(1)
    sums = np.add.reduceat(_OF_BYTE[b[at]] * of_place[place], starts)
    return _mix64(sums + lengths.astype(np.uint64) * _P)


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct shingle hashes of a whole text, sorted."""
    h = word_hashes(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else np.empty(0, np.uint64)
    if not len(h):
        return h
    if len(h) < SHINGLE:
        acc = np.full(1, len(h), np.uint64)
        for x in h:
            acc = _mix64(acc * _P + x)
        return acc
    n = len(h) - SHINGLE + 1
    acc = np.full(n, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        acc = _mix64(acc * _P + h[k : k + n])
    return np.unique(acc)


_SEEDS = (_mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * _P) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_TURNS = (_mix64(np.arange(1001, 1001 + 2 * BANDS * ROWS, dtype=np.uint64) * _P) >> np.uint64(32)).astype(np.uint32)


def minhashes(shingles: np.ndarray) -> np.ndarray:
    """2 * BANDS * ROWS minhashes of 32 bits; the first half makes the first collection."""
    low = np.full(len(_SEEDS), np.iinfo(np.uint32).max, np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    for a in range(0, len(x), 1024):
        h = x[None, a : a + 1024] ^ _TURNS[:, None]
        h *= _SEEDS[:, None]
        np.minimum(low, h.min(axis=1), out=low)
    return low


def first_keys(low: np.ndarray) -> np.ndarray:
    """The BANDS keys of the first collection, of 32 bits."""
    acc = np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        acc = _mix64(acc * _P + low[r : BANDS * ROWS : ROWS])
    return (acc >> np.uint64(32)).astype(np.uint32)


def sketch(low: np.ndarray) -> bytes:
    """The low bytes of all minhashes: what tells candidates apart inside a bucket."""
    return low.astype(np.uint8).tobytes()


def _set_id(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _keys(docs: DataFrame) -> DataFrame:
    """(id, n, cls, keys, sketch, body) for every row: cls is the digest of the set, null for empty sets. The band keys, the sketch
    and the compressed text come with the first row of a set in a task."""

    def run(batches):
        seen = set()
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            out = []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t)
                c = _set_id(s) if len(s) else None
                if c is None or c in seen:
                    out.append((len(s), c, None, None, None))
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                low = minhashes(s)
                out.append((len(s), c, first_keys(low).astype(">u4").tobytes(), sketch(low), pack.compress(t.encode("utf-8", "surrogatepass"))))
            n, *rest = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in rest)], ["id", "n", "cls", "keys", "sketch", "body"]
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n bigint, cls binary, keys binary, sketch binary, body binary")


def _groups(batches):
    """Rows of batches that are sorted by the first column, as tables by group; a group may span batches, and its columns have a chunk for each:
    one chunk could not hold binary columns of over 2 GiB."""
    own, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            if own and key[a] != last:
                yield pa.Table.from_batches(own)
                own = []
            own.append(batch.slice(a, b - a))
            last = key[a]
    if own:
        yield pa.Table.from_batches(own)


def _candidates(n: np.ndarray, sketches: np.ndarray, comp: np.ndarray | None, keys: np.ndarray | None, block: int = 256):
    """(a, scores): for the members of a bucket from a on, their agreement with each member before them, 0 if they aren't candidates.

    With comp, pairs of one component are no candidates; with keys, neither are pairs that share one of them. Those are the members' whole keys
    of the first collection before the bucket's own: sketches have low bytes only, and can agree where the keys, and so the buckets, differ.
    """
    by_hash = np.ascontiguousarray(sketches.T)
    for a in range(0, len(n), block):
        b = min(len(n), a + block)
        shared = np.zeros((b - a, b), np.uint8)
        second = np.zeros((b - a, b), bool)
        earlier = np.zeros((b - a, b), bool)
        for k in range(2 * BANDS):
            eq = [by_hash[k * ROWS + r, a:b, None] == by_hash[k * ROWS + r, None, :b] for r in range(ROWS)]
            for x in eq:
                shared += x
            if k >= BANDS:
                second |= np.logical_and.reduce(eq)
        for of_key in keys.T if keys is not None else ():
            earlier |= of_key[a:b, None] == of_key[None, :b]
        x, y = n[a:b, None], n[None, :b]
        ok = second & ~earlier & (shared >= LEAST) & (
            100 * np.minimum(x, y) >= PERCENT * np.maximum(x, y)
        ) & (np.arange(b)[None, :] < np.arange(a, b)[:, None])
        if comp is not None:
            ok &= comp[a:b, None] != comp[None, :b]
        yield a, np.where(ok, shared, 0)


def _columns(g: pa.Table):
    cls = g.column(1).to_pylist()
    sketches = np.frombuffer(b"".join(g.column(3).to_pylist()), np.uint8).reshape(len(cls), 2 * BANDS * ROWS)
    return cls, g.column(2).to_numpy(), sketches


def _best_pairs(buckets: DataFrame) -> DataFrame:
    """Pairs (a, b): each class of a bucket with the earlier member that agrees with it most."""

    def run(batches):
        for g in _groups(batches):
            if g.num_rows < 2:
                continue
            cls, n, sketches = _columns(g)
            pairs = []
            for a, score in _candidates(n, sketches, None, None):
                best = score.argmax(axis=1)
                pairs += [(cls[a + i], cls[best[i]]) for i in np.flatnonzero(score.max(axis=1))]
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([min(p) for p in pairs], pa.binary()), pa.array([max(p) for p in pairs], pa.binary())], ["a", "b"]
                )

    rows = buckets.repartition("key").sortWithinPartitions("key", "n", "cls").select("key", "cls", "n", "sketch")
    return rows.mapInArrow(run, "a binary, b binary").distinct()


def _codes(g: pa.Table, at: int) -> np.ndarray:
    index: dict[bytes, int] = {}
    return np.array([index.setdefault(c, len(index)) for c in g.column(at).to_pylist()])


def _earlier_keys(g: pa.Table, at: int) -> np.ndarray:
    """Each member's keys of the first collection before that of the bucket."""
    keys = np.frombuffer(b"".join(g.column(at).to_pylist()), ">u4").reshape(g.num_rows, BANDS)
    return np.ascontiguousarray(keys[:, : g.column(0)[0].as_py()[0]])


def _open_members(members: DataFrame) -> DataFrame:
    """(key, cls) of members that have a candidate in another component, each pair at the first key by which it meets."""

    def run(batches):
        for g in _groups(batches):
            comp = _codes(g, 4)
            if comp.max() == 0:
                continue
            key = g.column(0)[0].as_py()
            cls, n, sketches = _columns(g)
            open_ = np.zeros(len(cls), bool)
            for a, score in _candidates(n, sketches, comp, _earlier_keys(g, 5)):
                open_[a : a + len(score)] |= score.any(axis=1)
                open_[: score.shape[1]] |= score.any(axis=0)
            out = [cls[i] for i in np.flatnonzero(open_)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(out), pa.binary()), pa.array(out, pa.binary())], ["key", "cls"])

    rows = members.repartition("key").sortWithinPartitions("key", "n", "cls").select("key", "cls", "n", "sketch", "comp", "keys")
    return rows.mapInArrow(run, "key binary, cls binary")


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 8192) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, exact: products of 0/1 matrices over shingles that both sides have, in strips."""
    both = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(both), width):
        strip = both[at : at + width]
        mats = []
        for sets in (left, right):
            m = np.zeros((len(sets), len(strip)), np.float32)
            for i, s in enumerate(sets):
                own = s[np.searchsorted(s, strip[0]) : np.searchsorted(s, strip[-1], side="right")]
                k = np.searchsorted(strip, own)
                m[i, k[strip[k] == own]] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def _exact_links(members: DataFrame) -> DataFrame:
    """Links (a, b) between components among the open members of each bucket, from their full sets; one for each pair of components joined."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for g in _groups(batches):
            cls, n, sketches = _columns(g)
            comp = _codes(g, 4)
            body = g.column(6)
            sets = lambda ids: [shingle_set(unpack.decompress(body[int(i)].as_py()).decode("utf-8", "surrogatepass")) for i in ids]
            root = list(range(int(comp.max()) + 1))

            def find(x):
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            pairs = []
            for a, score in _candidates(n, sketches, comp, _earlier_keys(g, 5), block=64):
                for c in range(0, score.shape[1], 64):
                    part = score[:, c : c + 64] > 0
                    rows, cols = np.flatnonzero(part.any(axis=1)), np.flatnonzero(part.any(axis=0))
                    if not len(rows):
                        continue
                    inter = overlaps(sets(a + rows), sets(c + cols))
                    hit = part[np.ix_(rows, cols)] & (100 * inter >= PERCENT * (n[a + rows, None] + n[None, c + cols] - inter))
                    for i, j in zip(*np.nonzero(hit), strict=True):
                        x, y = a + int(rows[i]), c + int(cols[j])
                        u, v = find(comp[x]), find(comp[y])
                        if u != v:
                            root[max(u, v)] = min(u, v)
                            pairs.append((min(cls[x], cls[y]), max(cls[x], cls[y])))
            if pairs:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.binary())], ["a", "b"]
                )

    rows = members.repartition("key").sortWithinPartitions("key", "n", "cls").select("key", "cls", "n", "sketch", "comp", "keys", "body")
    return rows.mapInArrow(run, "a binary, b binary").distinct()


def _verify(pairs: DataFrame, bodies: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar enough. b's text goes to a's place in salted groups, so a popular a is split."""
    left = join_many(
        pairs, bodies.select(F.col("cls").alias("b"), F.col("body").alias("body_b")), "b"
    ).withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(8)).cast("int"))
    used = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(8)).cast("int").alias("salt")).distinct()
    own = join_many(used, bodies.select(F.col("cls").alias("a"), F.col("body").alias("body_a")), "a")
    rows = left.select("a", "salt", "b", F.col("body_b").alias("body")).unionByName(
        own.select("a", "salt", F.lit(None).cast("binary").alias("b"), F.col("body_a").alias("body"))
    )
    rows = rows.repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        of = lambda body: shingle_set(unpack.decompress(body).decode("utf-8", "surrogatepass"))
        key = own = None
        for batch in pieces(batches):
            out = []
            for a, salt, b, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b is None:
                    key, own = (a, salt), of(body)
                    continue
                assert key == (a, salt), "a group starts with its own text"
                other = of(body)
                both = len(np.intersect1d(own, other, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(other) - both):
                    out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["a", "b"])

    return rows.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, sc: Scratch, tag: str) -> DataFrame:
    """(cls, comp): comp is the smallest class reachable; for classes with links. Hooking and pointer jumping, in O(log n) rounds."""
    both = sc.save(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{tag}-links")
    label = both.groupBy(F.col("a").alias("v")).agg(F.min(F.least("a", "b")).alias("l"))
    label = sc.save(label, f"{tag}-0")
    i = 0
    while True:
        near = join_many(both, label.select(F.col("v").alias("b"), "l"), "b").groupBy(F.col("a").alias("v")).agg(F.min("l").alias("m"))
        # every node takes the smallest label around it; the root of its old label takes it as well
        step = join_many(label, near, "v").select("v", "l", F.least("l", "m").alias("m"))
        hook = step.groupBy(F.col("l").alias("v")).agg(F.min("m").alias("h"))
        new = join_many(step, hook, "v", "left").select("v", F.col("l").alias("old"), F.least("m", F.coalesce("h", "m")).alias("l"))
        jump = new.select(F.col("v").alias("l"), F.col("l").alias("j"))
        new = join_many(new, jump, "l", "left").select("v", "old", F.least("l", F.coalesce("j", "l")).alias("l"))
        i += 1
        after = sc.save(new, f"{tag}-{i}")
        changed = after.where("old <> l").limit(1).count()
        sc.drop(f"{tag}-{i - 1}")
        label = after.select("v", "l")
        if not changed:
            return label.select(F.col("v").alias("cls"), F.col("l").alias("comp"))


def near_duplicates(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row."""
    spark = df.sparkSession
    sc = Scratch(spark, "minhash")
    docs = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    raw = sc.save(_keys(docs), "raw")
    own = raw.where("keys IS NOT NULL")
    classes = own.select("cls", "n", "keys", "sketch").distinct()
    classes = sc.save(classes, "classes")
    key = lambda i: F.concat(F.lit(bytes([i])), F.substring("keys", 4 * i + 1, 4))
    # keys are counted, and met, by slim rows; sketches and all keys join only what has met
    by_key = classes.select("cls", F.explode(F.array(*map(key, range(BANDS)))).alias("key"))
    met = by_key.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    buckets = sc.save(join_many(join_many(by_key, met, "key"), classes, "cls").select("key", "cls", "n", "keys", "sketch"), "buckets")
    sc.drop("classes")
    bodies = join_many(own.select("cls", "body"), buckets.select("cls").distinct(), "cls", "left_semi")
    bodies = bodies.groupBy("cls").agg(F.first("body").alias("body"))
    bodies = sc.save(bodies, "bodies")
    links = sc.save(_verify(sc.save(_best_pairs(buckets), "pairs"), bodies), "good")
    comp = components(links, sc, "c0")
    placed = lambda rows: join_many(rows, comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    still = sc.save(_open_members(placed(buckets)), "open")
    if not still.isEmpty():
        members = join_many(placed(join_many(still, buckets, ["key", "cls"])), bodies, "cls")
        more = sc.save(_exact_links(members), "more")
        if not more.isEmpty():
            comp = components(links.unionByName(more), sc, "c1")
    sc.drop("bodies", "buckets")
    name = sc.save(placed(raw.select("id", "n", "cls")).select("id", "n", "comp"), "named")
    sc.drop("raw")
    # classes of one row are their own least; the others' least is broadcast after a count, or meets salted keys
    least = name.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("id").alias("least"), F.count("*").alias("c")).where("c > 1").drop("c")
    out = join_few(name, sc.save(least, "least"), "comp", "id").withColumn("component_id", F.coalesce("least", "id"))
    return out.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )
