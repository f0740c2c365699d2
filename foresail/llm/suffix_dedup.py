"""Removal of repeated substrings by external induced suffix sorting.

Every byte that a 400-byte string covers which also starts elsewhere is removed; matches lie inside documents and are judged on the input.

1. Shards. A window of 256 bytes has as key the smallest hash of its 32-byte grams, so equal windows have equal keys wherever they
   stand. Neighbouring windows with one key make a fragment, which also holds what follows up to 400 bytes from its last window's start. Keys that only
   one fragment has, with the smallest gram at one place, hold no repeat; the other
   fragments meet by key. Equal fragments collapse to one with a weight first, so thousands of copies travel once.
2. Induced sorting. Each task sorts the suffixes of its fragments: LMS substrings are named, the reduced string is sorted (by recursion, or in memory once it fits),
   and L- and S-suffixes are induced from it. The scans run over priority queues of (first character, arrival) that carry suffix and
   common-prefix length and go to disk in blocks beyond a memory limit; common prefixes are carried through induction as range minima and cut at 400.
3. Runs of suffixes with common prefixes of 400 and a weight of 2 or more are the repeats; they go back to documents as ranges of bytes.
   Runs with common prefixes of 256, as of 51 words with four letters and the blanks between, tell of passages that repeat but stay; their bytes are counted.

Null and empty texts have no bytes. Repeated rows and ids are documents of their own, so two equal rows of 400 bytes or more remove each other. Texts under
400 bytes keep all. Very long texts are cut into fragments like others, whole. Other columns of the input are not read, so their names can't clash. An empty
table gives an empty table. One key's distinct fragments are one task's work: their text, types and ranks are in its memory, the queues of the induction are not.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from .common import Scratch, pieces

LENGTH = 400
SHORT = 256
GRAM = 32
MOST_WINDOWS = 1 << 14
CHUNK_BYTES = 3 << 20
QUEUE_BYTES = 16 << 20
IN_MEMORY = 1 << 25
_A = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


# --- 1. windows, keys and fragments


def gram_hashes(b: np.ndarray) -> np.ndarray:
    """A hash of each 32-byte gram."""
    x = b.astype(np.uint64)
    for bits in (8, 16, 32):
        k = bits // 8
        x = x[:-k] | (x[k:] << np.uint64(bits))
    n = len(b) - GRAM + 1
    h = x[:n] * _A[0]
    for k in (1, 2, 3):
        h += (x[8 * k : 8 * k + n] ^ (h >> np.uint64(29))) * _A[k]
    h ^= h >> np.uint64(32)
    h *= _A[1]
    return h ^ (h >> np.uint64(29))


def fragments_of(b: np.ndarray, length: int = SHORT) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, first window, last window, whether the smallest gram stands at several places) of each fragment."""
    none = np.empty(0, np.int64)
    if len(b) < length:
        return none, none, none, none.astype(bool)
    h = gram_hashes(b)
    wide = length - GRAM + 1
    low, span = h, 1
    while 2 * span <= wide:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if wide > span:
        low = np.minimum(low[: len(h) - wide + 1], low[wide - span : wide - span + len(h) - wide + 1])
    cut = np.flatnonzero(low[1:] != low[:-1]) + 1
    starts, ends = np.r_[0, cut], np.r_[cut, len(low)]
    if (ends - starts).max() > MOST_WINDOWS:
        starts = np.concatenate([np.arange(a, e, MOST_WINDOWS) for a, e in zip(starts, ends, strict=True)])
        ends = np.r_[starts[1:], len(low)]
    keys = low[starts]
    several = np.array([np.count_nonzero(h[a : e - 1 + wide] == k) > 1 for a, e, k in zip(starts, ends, keys, strict=True)], bool)
    return keys.view(np.int64), starts, ends - 1, several


def _scan(docs: DataFrame) -> DataFrame:
    """(k, id, n_bytes, sha, z, runs) by row; k tells rows apart by id and text, z is the compressed text."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in pieces(batches):
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            k, n, sha, z, runs = [], [], [], [], []
            for i, t in zip(ids.to_pylist(), texts, strict=True):
                data = (t or "").encode("utf-8", "surrogatepass")
                key, a, e, several = fragments_of(np.frombuffer(data, np.uint8))
                k.append(hashlib.blake2b(repr(i).encode() + b"\0" + data, digest_size=16).digest())
                n.append(len(data))
                sha.append(hashlib.sha256(data).hexdigest())
                z.append(pack.compress(data) if len(key) else None)
                runs.append((key, a, e, several))
            offsets = np.cumsum([0, *(len(r[0]) for r in runs)], dtype=np.int32)
            cat = lambda i, kind: pa.array(np.concatenate([r[i] for r in runs]).astype(kind))  # noqa: E731, B023
            items = pa.StructArray.from_arrays([cat(0, np.int64), cat(1, np.int32), cat(2, np.int32), cat(3, bool)], ["h", "a", "e", "several"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(k, pa.binary()), ids, pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(z, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(offsets), items)
                ],
                ["k", "id", "n_bytes", "sha", "z", "runs"]
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.select("id", "text").mapInArrow(
        run, f"k binary, id {kind}, n_bytes bigint, sha string, z binary, runs array<struct<h:bigint,a:int,e:int,several:boolean>>"
    )


def _digests(rows: DataFrame) -> DataFrame:
    """(k, h, a, e, several, size, dig) of the runs of rows (k, z, runs); size and digest are of the fragment's bytes."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in pieces(batches):
            out = []
            for k, z, runs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack.decompress(z)
                for r in runs:
                    body = data[r["a"] : r["e"] + LENGTH]
                    out.append((k, r["h"], r["a"], r["e"], r["several"], len(body), hashlib.blake2b(body, digest_size=16).digest()))
            cols = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["k", "h", "a", "e", "several", "size", "dig"]
            )

    return rows.select("k", "z", "runs").mapInArrow(run, "k binary, h bigint, a int, e int, several boolean, size int, dig binary")


def _contents(rows: DataFrame) -> DataFrame:
    """(h, dig, m, windows, body) from rows (z, picks): the bytes of one representative of each distinct fragment and how many windows start in it."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in pieces(batches):
            out = []
            for z, picks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = unpack.decompress(z)
                out += [(p["h"], p["dig"], p["m"], p["e"] - p["a"] + 1, data[p["a"] : p["e"] + LENGTH]) for p in picks]
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["h", "dig", "m", "windows", "body"])

    return rows.select("z", "picks").mapInArrow(run, "h bigint, dig binary, m bigint, windows int, body binary")


# --- 2. induced sorting


class DiskQueue:
    """A priority queue of suffix tuples (position, common prefix) by first character and arrival; blocks beyond the limit lie on disk."""

    def __init__(self, limit: int = QUEUE_BYTES):
        self.blocks: dict[int, list] = {}
        self.size, self.limit, self.file = 0, limit, None

    def push(self, char: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        self.blocks.setdefault(char, []).append((pos, lcp))
        self.size += pos.nbytes + lcp.nbytes
        if self.size > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # noqa: SIM115  gone with the task
        for blocks in self.blocks.values():
            for i, block in enumerate(blocks):
                if isinstance(block[0], np.ndarray):
                    self.file.seek(0, 2)
                    at = self.file.tell()
                    for x in block:
                        self.file.write(np.ascontiguousarray(x).tobytes())
                    blocks[i] = (at, len(block[0]), block[0].dtype, block[1].dtype)
        self.size = 0

    def pop(self, char: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that has arrived for a character so far, in order of arrival."""
        blocks = self.blocks.pop(char, None)
        if not blocks:
            return None
        got = []
        for block in blocks:
            if isinstance(block[0], np.ndarray):
                self.size -= block[0].nbytes + block[1].nbytes
                got.append(block)
            else:
                at, n, kind_p, kind_l = block
                self.file.seek(at)
                got.append((np.frombuffer(self.file.read(n * kind_p.itemsize), kind_p), np.frombuffer(self.file.read(n * kind_l.itemsize), kind_l)))
        return got[0] if len(got) == 1 else tuple(np.concatenate(x) for x in zip(*got, strict=True))


def _range_min(x: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minima of x over [first, last], by a sparse table."""
    width = (last - first + 1).astype(np.int64)
    level = np.frexp(width.astype(np.float64))[1] - 1
    out = np.empty(len(first), x.dtype)
    table, k = x, 0
    for want in range(int(level.max()) + 1):
        while k < want:
            table = np.minimum(table[: len(table) - (1 << k)], table[1 << k :])
            k += 1
        at = np.flatnonzero(level == want)
        if len(at):
            out[at] = np.minimum(table[first[at]], table[last[at] - (1 << want) + 1])
    return out


def _refine(rank: np.ndarray, key: np.ndarray, at: np.ndarray, bits: int) -> np.ndarray:
    """Ranks (how many are smaller) of the items at `at`, refined in place by a further key of some bits; returns those that still tie."""
    key = (rank[at] << bits) | key
    order = np.argsort(key)
    at, key = at[order], key[order]
    r = key >> bits
    new_group = np.r_[True, r[1:] != r[:-1]]
    new_item = np.r_[True, key[1:] != key[:-1]]
    place = np.arange(len(at))
    rank[at] = r + np.maximum.accumulate(np.where(new_item, place, 0)) - np.maximum.accumulate(np.where(new_group, place, 0))
    tie = np.zeros(len(at), bool)
    tie[1:] = ~new_item[1:]
    tie[:-1] |= ~new_item[1:]
    return at[tie]


class InducedSorter:
    """Suffix order and common prefixes, cut at `depth`, of a string over small integers whose last character, 0, is its smallest."""

    def __init__(self, text: np.ndarray, depth: int = LENGTH, queue_bytes: int = QUEUE_BYTES, in_memory: int = IN_MEMORY):
        self.t, self.n, self.depth, self.queue_bytes, self.in_memory = text, len(text), depth, queue_bytes, in_memory
        change = np.flatnonzero(text[:-1] != text[1:])
        up = text[change] < text[change + 1]
        of = np.repeat(up, np.diff(change, prepend=-1))  # type S up to each change
        self.s = np.ones(self.n, bool)
        self.s[: len(of)] = of
        self.lms = np.flatnonzero(self.s[1:] & ~self.s[:-1]) + 1
        self.words = None

    def prefix(self, p: np.ndarray, q: np.ndarray, least: np.ndarray | None = None) -> np.ndarray:
        """Common prefixes of suffixes p and q, cut at depth; by eight characters at a time where they are bytes. least: what they share at the least."""
        out = np.zeros(len(p), np.int64) if least is None else least.copy()
        live = np.arange(len(p))
        while len(live):
            a, b = p[live] + out[live], q[live] + out[live]
            ok = (a < self.n) & (b < self.n)
            if self.words is not None:
                x = self.words[np.minimum(a, self.n - 1)] ^ self.words[np.minimum(b, self.n - 1)]
                low = x & (~x + np.uint64(1))
                same = np.where(x == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            else:
                same = (self.t[np.minimum(a, self.n - 1)] == self.t[np.minimum(b, self.n - 1)]).astype(np.int64)
            full = 8 if self.words is not None else 1
            out[live] += np.where(ok, same, 0)
            live = live[ok & (same == full) & (out[live] < self.depth)]
        return np.minimum(out, self.depth).astype(np.uint16)

    def neighbours(self, seeds: np.ndarray) -> np.ndarray:
        """Common prefixes of each sorted LMS suffix with the one before it, 0 for the first.

        In the text's order a suffix d characters on shares at least d fewer with its own neighbour, so coarse steps spare fine ones most
        comparisons. That holds if its neighbour is the earlier one's, d characters on too; else if the earlier two differ within the depth, so that
        their order is settled, and the later suffix's run of equal characters ends in what they share, so that its kind is.
        """
        out = np.zeros(len(seeds), np.int64)
        order = np.argsort(seeds)  # the text's order; place 0 of the sorted order has no neighbour
        order = order[order > 0]
        pos, before = seeds[order], seeds[order - 1]
        got = np.zeros(len(order), np.int64)
        change = np.flatnonzero(self.t[:-1] != self.t[1:]) + 1
        settled = np.r_[change, self.n][np.searchsorted(change, pos, side="right")] - pos + 1
        for step in (64, 16, 4, 1):
            at = np.arange(0, len(order), step)
            if step < 64:
                at = at[at % (4 * step) != 0]
            if not len(at):
                continue
            least = np.zeros(len(at), np.int64)
            if step < 64:
                left = at // (4 * step) * (4 * step)
                far = pos[at] - pos[left]
                rest = got[left] - far
                along = before[at] - before[left] == far  # the same pair of places, further on
                sure = (got[left] < self.depth) & (rest > settled[at])
                least = np.where(along | sure, np.maximum(rest, 0), 0)
            got[at] = self.prefix(pos[at], before[at], least)
        out[order] = got
        return out.astype(np.uint16)

    def _sorted_lms(self) -> np.ndarray:
        """LMS suffixes in order: names of the substrings between them, then the order of the string of names."""
        lms, m = self.lms, len(self.lms)
        code = (self.t.astype(np.int64) << 1) | self.s
        length = np.diff(lms, append=self.n - 1) + 1
        rank = np.zeros(m, np.int64)
        own = m.bit_length()  # of a rank; what is left of 62 bits holds codes
        bits = int(code.max()).bit_length()
        wide = max(1, (62 - own) // bits)
        live, at = np.arange(m), 0
        while len(live) and at <= self.depth:
            key = np.zeros(len(live), np.int64)
            for k in range(wide):
                p = lms[live] + at + k
                key = (key << bits) | np.where(at + k < length[live], code[np.minimum(p, self.n - 1)], 0)
            live = _refine(rank, key, live, wide * bits)
            at += wide
            live = live[length[live] > at]
        if m > self.in_memory and len(np.unique(rank)) < m:
            names = np.unique(rank, return_inverse=True)[1]
            inner = InducedSorter(names, self.depth, self.queue_bytes, self.in_memory)
            order = [p for p, _ in inner.run()][::-1]
            return lms[np.concatenate([np.array([m - 1]), *order]).astype(np.int64)]
        step = 1
        counts = np.bincount(rank, minlength=m)
        live = np.flatnonzero(counts[rank] > 1)
        while len(live) and step <= self.depth:
            after = live + step
            key = np.where(after < m, rank[np.minimum(after, m - 1)] + 1, 0)
            live = _refine(rank, key, live, own)
            step *= 2
        return lms[np.argsort(rank, kind="stable")]

    def _induce(self, queue: DiskQueue, pos: np.ndarray, lcp: np.ndarray, want_s: bool) -> None:
        """Sends the predecessors of a batch of scanned suffixes to their buckets, with common prefixes as minima over what was scanned in between."""
        before = pos - 1
        ok = np.flatnonzero((pos > 0) & (self.s[before] == want_s))
        low = lcp.min()
        if not len(ok):
            np.minimum(self.gap, low, out=self.gap, where=self.seen)
            return
        chars = self.t[before[ok]]
        order = np.argsort(chars, kind="stable")
        at, chars = ok[order], chars[order]
        head = np.r_[True, chars[1:] != chars[:-1]]
        first = np.where(head, 0, np.r_[0, at[:-1] + 1])
        new = _range_min(lcp, first, at)
        heads = np.flatnonzero(head)
        ends = np.r_[heads[1:], len(at)]
        group = chars[heads]
        known = self.seen[group]
        new[heads] = np.where(known, np.minimum(new[heads], self.gap[group]), 0)
        value = np.minimum(new.astype(np.int64) + 1, self.depth).astype(np.uint16)
        value[heads[~known]] = 0
        # what comes after the last one of each bucket
        np.minimum(self.gap, low, out=self.gap, where=self.seen)
        last = at[ends - 1]
        rest = np.minimum.accumulate(lcp[::-1])[::-1]
        self.gap[group] = np.where(last + 1 < len(lcp), rest[np.minimum(last + 1, len(lcp) - 1)], self.depth)
        self.seen[group] = True
        pos = before[at]
        for c, a, e in zip(group.tolist(), heads.tolist(), ends.tolist(), strict=True):
            queue.push(c, pos[a:e], value[a:e])

    def _rounds(self, queue: DiskQueue, char: int, want_s: bool):
        got = []
        while (batch := queue.pop(char)) is not None:
            got.append(batch)
            self._induce(queue, *batch, want_s)
        return tuple(np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.empty(0, np.int64), np.empty(0, np.uint16))

    def run(self):
        """(suffixes, common prefix of each with the one before it) for each first character, descending; 0 at a character's first.

        The last suffix, the end mark alone, is left out.
        """
        seeds = self._sorted_lms()
        if len(seeds) == 0:
            seeds = np.array([self.n - 1])
        lcp = self.neighbours(seeds)
        top = int(self.t.max()) + 1
        of = self.t[seeds]
        bounds = np.searchsorted(of, np.arange(top + 1))
        self.gap, self.seen = np.full(top, self.depth, np.uint16), np.zeros(top, bool)
        queue, larger = DiskQueue(self.queue_bytes), {}
        present = np.flatnonzero(np.bincount(self.t, minlength=top)).tolist()
        for c in present:
            larger[c] = self._rounds(queue, c, False)
            a, e = bounds[c], bounds[c + 1]
            if e > a:
                p, x = seeds[a:e], lcp[a:e].copy()
                before = larger[c][0][-1:]
                x[0] = self.prefix(before, p[:1])[0] if len(before) else 0
                self._induce(queue, p, x, False)
        self.gap[:], self.seen[:] = self.depth, False
        queue = DiskQueue(self.queue_bytes)
        for c in reversed(present):
            small, x = self._rounds(queue, c, True)
            p, y = larger.pop(c)
            seam = self.prefix(p[-1:], small[-1:]) if len(p) and len(small) else np.zeros(1, np.uint16)
            if len(p):
                self._induce(queue, p[::-1], np.r_[seam, y[1:][::-1]].astype(np.uint16), True)
            tail = np.r_[seam, x[1:][::-1]].astype(np.uint16)[: len(small)]
            yield np.r_[p, small[::-1]], np.r_[y, tail].astype(np.uint16)


def repeated_windows(
    bodies: list[bytes], weights: list[int], windows: list[int], lengths: tuple[int, ...] = (SHORT, LENGTH), **limits
) -> list[list[np.ndarray]]:
    """For each length and fragment, which of the fragment's windows have their first bytes of that length elsewhere too: in another
    fragment or place, or the fragment weighs 2. Of a window with fewer bytes up to the fragment's end, none are."""
    depth = max(lengths)
    raw = np.frombuffer(b"\xff".join(bodies) + b"\xff", np.uint8)  # no text in UTF-8 has this byte
    ends = np.cumsum([len(b) + 1 for b in bodies])
    starts = ends - np.array([len(b) + 1 for b in bodies])
    text = np.where(raw == 0xFF, 0, raw.astype(np.int16) + 1)
    weight = np.zeros(len(raw), np.int64)
    for a, n, w in zip(starts, windows, weights, strict=True):
        weight[a : a + n] = w
    sorter = InducedSorter(text, depth, **limits)
    x = np.r_[raw, np.full(7, 0xFE, np.uint8)].astype(np.uint64)
    for bits in (8, 16, 32):
        x = x[: -(bits // 8)] | (x[bits // 8 :] << np.uint64(bits))
    sorter.words = x
    hits = [np.zeros(len(raw), bool) for _ in lengths]
    for pos, lcp in sorter.run():
        if len(pos):
            own = weight[pos]
            for hit, length in zip(hits, lengths, strict=True):
                heads = np.flatnonzero(lcp < length)
                hit[pos] = np.repeat(np.add.reduceat(own, heads), np.diff(heads, append=len(pos))) > 1
    room = np.repeat(ends, np.diff(ends, prepend=0)) - 1 - np.arange(len(raw))  # bytes up to the fragment's end
    hits = [hit & (weight > 0) & (room >= length) for hit, length in zip(hits, lengths, strict=True)]
    return [[hit[a : a + n] for a, n in zip(starts, windows, strict=True)] for hit in hits]


def _ranges(hit: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(hit.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist(), strict=True))


def _sort_shards(fragments: DataFrame, chunk_bytes: int = CHUNK_BYTES, **limits) -> DataFrame:
    """(h, dig, brief, ranges) from rows (h, dig, m, windows, body): windows of each fragment that repeat over SHORT and over LENGTH bytes, as
    ranges of their starts."""
    kind = pa.list_(pa.struct([("x", pa.int32()), ("y", pa.int32())]))

    def run(batches):
        def flush(rows):
            brief, long = repeated_windows([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], **limits)
            pairs = lambda h: [{"x": x, "y": y} for x, y in _ranges(h)]
            got = [(r[0], r[1], pairs(b), pairs(h)) for r, b, h in zip(rows, brief, long, strict=True) if b.any()]
            cols = list(zip(*got, strict=True)) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), kind, kind), strict=True)], ["h", "dig", "brief", "ranges"]
            )

        rows, held = [], 0
        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held > chunk_bytes and r[0] != rows[-1][0]:  # a key's fragments stay together
                    yield flush(rows)
                    rows, held = [], 0
                rows.append(r)
                held += len(r[4])
        if rows:
            yield flush(rows)

    rows = fragments.repartition("h").sortWithinPartitions("h", "dig").select("h", "dig", "m", "windows", "body")
    return rows.mapInArrow(run, "h bigint, dig binary, brief array<struct<x:int,y:int>>, ranges array<struct<x:int,y:int>>")


# --- 3. documents


def _merged(spans: list[dict]) -> list[list[int]]:
    out: list[list[int]] = []
    for s in spans:
        if out and s["x"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["y"])
        else:
            out.append([s["x"], s["y"]])
    return out


def dedup_substrings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id_col, n_bytes, n_removed, n_spans, kept_sha256, spans, n_repeated) for every row; spans are the removed ranges, ends exclusive, and
    n_repeated counts bytes of passages of SHORT bytes or more that repeat, removed or not."""
    sc = Scratch(df.sparkSession, "suffix")
    kind = df.schema[id_col].dataType.simpleString()
    docs = sc.save(_scan(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))), "scan")
    runs = docs.select("k", F.explode("runs").alias("r")).select("k", "r.*")
    shared = runs.groupBy("h").agg(F.count("*").alias("c"), F.max("several").alias("s")).where("c > 1 OR s").select("h")
    # by document, the runs whose key occurs elsewhere; equal rows have one k and one set of runs, and each keeps them
    marked = runs.join(shared, "h").groupBy("k").agg(F.collect_set(F.struct("h", "a", "e", "several")).alias("runs"))
    held = sc.save(docs.select("k", "id", "n_bytes", "z").join(marked, "k"), "held")
    found = sc.save(_digests(held), "found")
    kinds = found.groupBy("h", "dig").agg(
        F.count("*").alias("m"), F.max("several").alias("s"), F.max("size").alias("size"), F.min(F.struct("k", "a", "e")).alias("one")
    )
    kinds = sc.save(kinds, "kinds")
    groups = kinds.groupBy("h").agg(F.count("*").alias("d"), F.sum("m").alias("n"), F.max("s").alias("s"))
    many = groups.where("d > 1 OR s").select("h")
    picks = kinds.join(many, "h").select(
        "one.k", F.struct("h", "dig", "m", "one.a", "one.e").alias("p")
    ).groupBy("k").agg(F.collect_list("p").alias("picks"))
    bodies = _contents(held.select("k", "z").dropDuplicates(["k"]).join(picks, "k"))
    ranges = sc.save(_sort_shards(bodies), "ranges")
    # a key whose fragments are all equal needs no sorting: one distinct fragment, twice or more
    alone = kinds.join(groups.where("d = 1 AND NOT s AND n > 1").select("h"), "h")
    last = F.col("one.e") - F.col("one.a")
    whole = lambda y: F.array(F.struct(F.lit(0).alias("x"), y.cast("int").alias("y")))
    none = F.array().cast("array<struct<x:int,y:int>>")
    alone = alone.select(
        "h", "dig", whole(last).alias("brief"),
        F.when(F.col("size") >= LENGTH, whole(F.least(last, F.col("size") - LENGTH))).otherwise(none).alias("ranges")
    )
    hits = found.select("k", "h", "dig", "a").distinct().join(ranges.unionByName(alone), ["h", "dig"])
    at = lambda c, length: F.transform(
        c, lambda r: F.struct((F.col("a") + r["x"]).alias("x"), (F.col("a") + r["y"] + length).alias("y"))
    )
    hits = hits.select("k", at("brief", SHORT).alias("brief"), at("ranges", LENGTH).alias("ranges"))
    spans = hits.groupBy("k").agg(*[F.sort_array(F.flatten(F.collect_list(c))).alias(c) for c in ("brief", "ranges")])
    hit = held.select("k", "id", "n_bytes", "z").join(spans, "k")

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in pieces(batches):
            out = []
            for z, spans, brief in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                data, merged = unpack.decompress(z), _merged(spans)
                kept, at = hashlib.sha256(), 0
                for x, y in merged:
                    kept.update(data[at:x])
                    at = y
                kept.update(data[at:])
                removed, repeated = (sum(y - x for x, y in m) for m in (merged, _merged(brief)))
                out.append((removed, len(merged), kept.hexdigest(), ",".join(f"{x}:{y}" for x, y in merged), repeated))
            cols = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            own = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *own], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "n_repeated"]
            )

    schema = f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans string, n_repeated bigint"
    cut_rows = hit.select("id", "n_bytes", "z", F.col("ranges").alias("spans"), "brief").mapInArrow(cut, schema)
    zero = lambda c: F.lit(0).cast("bigint").alias(c)
    rest = docs.select("k", "id", "n_bytes", "sha").join(spans.select("k"), "k", "left_anti")
    rest = rest.select(
        "id", "n_bytes", zero("n_removed"), zero("n_spans"), F.col("sha").alias("kept_sha256"), F.lit("").alias("spans"), zero("n_repeated")
    )
    return cut_rows.unionByName(rest).withColumnRenamed("id", id_col)
