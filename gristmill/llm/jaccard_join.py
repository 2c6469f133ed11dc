"""Operator 5. Exact n-gram Jaccard join by universe partition, pigeonhole and one-deletion neighbourhoods.

Two documents join if the Jaccard similarity of their sets of word n-grams is at least ``threshold``. For sets r and s
with |r| <= |s| <= |r| / t the symmetric difference is at most H = (1-t)/t * |r|.

* Size bands: sizes are cut into bands of ratio 1/t. Band b serves the pairs whose smaller set lies in it, so a set is
  indexed in its own band and in the next lower one. H of a set in a band is that of its own size, or of the band's largest if that is less.
* Universe partition: in a band the universe of grams is hashed into m segments; a set's subset in a segment has a
  signature. With allowance v = 1 a segment is indexed by its subset; with v = 2 also by its one-deletion neighbourhood
  (each subset less one gram), which finds subsets that differ by one gram. If no segment of a pair is found, its
  difference is at least the sum of allowances; so allowances of H + 1 in all find every pair.
* Frequent grams: a gram of more than ``LEAST_FREQUENT`` documents (as a sample of the documents has it) takes no part in the segments,
  else documents would meet for a common phrase, the more of them the larger the input. Leaving the same grams out of both sets
  only lowers their difference, so H still bounds it and no pair is lost whichever grams are left out; what a set then lacks counts as its loss.
* Subsets of at most q grams (empty ones above all) would match everywhere: they get allowance 0. What a set loses
  so (v for each segment it skips, 1 for each subset of q + 1 grams where v = 2) must be covered by slack in the number
  of segments. A set that loses more than the slack repeats its band with another partition, and after ``ROUNDS``
  partitions (at once where no allocation covers a band's sets) it indexes the single grams of its prefix (|x| - ceil(t|x|) + 1 of them, frequent ones last, by their number). A pair is found in the first round in
  which either of its sets is covered, or by a prefix gram: nothing is missed.
* Cost-based allocation: for each band v, q and m are chosen by an estimate of signatures written plus candidates
  checked.

Signatures travel as packed blocks (task and partition wise), not as rows. A band has a range of the partitions in proportion to its
text, so that a set meets only the partitions of its own two bands; of a key 32 bits travel, those that the partition doesn't
tell. Sets that are equal in size and a 64-bit sum are candidates by their least document only, so that copies cost one row
each (``similar_pairs`` returns them so, ``all_similar_pairs`` expands each set to its documents after verification). Candidates
leave a partition as the components that they make there, not as pairs: a group of near copies is one row a document. In each component of the candidates
every two sets are compared on the words themselves, by pairs of blocks of about ``VERIFY_BYTES`` of text, as bit sets; copies are compared
with their least document. Should two different sets share size and sum, the join is done again with another hash. Candidate keys are
hashes: a collision makes a false candidate, which verification drops.

``linked_documents`` has a row a document with its class and number of links and never writes the pairs.

Defined cases: NULL and empty texts have no grams and join nothing; a text of fewer than n words has one gram; a pair of
documents of equal sets has similarity 1; rows that share a doc_id are documents of their own, and pairs with
one id on both sides are left out of the results; other columns take no part.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gristmill.llm.common import drop_rows, join_rows, small_batches, unpacked, with_row_id, written
from gristmill.llm.grams import U, chunks, mix, ngrams, planes, unplanes, words
from gristmill.llm.worker import tidied, tidied_stream

N = 2
THRESHOLD = 0.7
ROUNDS = 3
#: Bytes of text whose signatures a reducer gets, about: the number of reducers grows with the input.
PARTITION_BYTES = 32 << 20
#: Bytes of text to a gram, for the share of the partitions that a band gets; nothing else depends on it.
GRAM_BYTES = 7
FLUSH = 1 << 19
#: Documents from which on a gram is frequent, whatever the input: what a document meets by one gram doesn't grow with it.
LEAST_FREQUENT = 128
#: They are found in a sample of so many documents, or of this share of all if that is more, in which a frequent gram has so many at least.
SAMPLE, SAMPLE_SHARE, SEEN = 16_384, 1 / 48, 3
#: Frequent grams at most; where there are more, the most frequent ones.
MOST_FREQUENT = 1 << 20
#: Share of a set's other grams that an unrelated set has too, for the costs.
OVERLAP = 0.0005
#: Grams that a sampling task holds, and about those that are counted side by side.
COUNTED = 1 << 20
#: What checking a candidate by its parity map costs against writing, moving and sorting a signature.
CANDIDATE_COST = 0.1
#: Signatures of a reducer whose partners are looked up side by side.
PAIR_STEP = 1 << 18
#: Text of a component that is verified side by side; larger components go in pairs of such blocks.
VERIFY_BYTES = 4 << 20
#: Documents of a set whose pairs with all of the set one task makes.
EXPAND_BLOCK = 256
_SPLIT = re.compile("[\x00-\x20]+")
_48 = U((1 << 48) - 1)


class Plan:
    """Bands of sizes and, for each band, (v, q, m, slack): see the module. Other arguments than the threshold only weigh costs."""

    def __init__(self, threshold: float, rows: int = 1 << 20, cold: float = 1.0, overlap: float = 0.15):
        """cold: share of a set's grams that aren't frequent; overlap: share of them that an unrelated set has too."""
        self.t, self.rows, self.cold, self.overlap = threshold, max(rows, 1), cold, overlap
        self._bands: dict[int, tuple[int, int, int, int]] = {}

    def need(self, size: np.ndarray | int) -> np.ndarray:
        """The least sum of allowances that finds every partner of which the smaller set has at most this size."""
        return np.floor((1 - self.t) / self.t * np.asarray(size) + 1e-9).astype(np.int64) + 1

    def band(self, size: np.ndarray) -> np.ndarray:
        return np.floor(np.log(np.maximum(size, 1)) / math.log(1 / self.t) + 1e-9).astype(np.int64)

    def lowest(self, size: np.ndarray) -> np.ndarray:
        """The band of the smallest set that may join a set of this size."""
        return self.band(np.ceil(size * self.t - 1e-9))

    def allocation(self, b: int) -> tuple[int, int, int, int]:
        """(v, q, m, largest size of the band); m = 0: the band is indexed by prefixes alone."""
        if b not in self._bands:
            lo = max(1, math.ceil((1 / self.t) ** (b - 1e-9) - 1e-9))
            hi = max(lo, math.floor((1 / self.t) ** (b + 1 + 1e-9)))
            self._bands[b] = (*min(self._options(lo, hi))[1], hi)
        return self._bands[b]

    def _options(self, lo: int, hi: int) -> Iterator[tuple[float, tuple[int, int, int]]]:
        need = int(self.need(hi))
        yield 1e300 if need > 1 else 0.0, (1, 0, 0 if need > 1 else 1)
        for v in (1, 2):
            for q in range(5):
                base = math.ceil(need / v)
                for m in range(base, 4 * base + 8):
                    if all(self._covered(size, v, q, m) for size in (lo, hi)):
                        size = (lo + hi) / 2 * self.cold
                        k = size / m
                        p = [math.exp(-k) * k**i / math.factorial(i) for i in range(q + 1)]
                        signatures = m * (1 - sum(p)) + (size - m * sum(i * x for i, x in enumerate(p)) if v == 2 else 0)
                        apart = 1.6 * k  # grams of an unrelated pair in a segment that only one of the two has
                        equal = math.exp(-apart) * (1 + apart if v == 2 else 1)
                        both = self.overlap * k
                        some = 1 - sum(math.exp(-both) * both**i / math.factorial(i) for i in range(q + 1))
                        yield signatures + CANDIDATE_COST * self.rows / 16 * m * equal * some, (v, q, m)
                        break

    def _covered(self, size: int, v: int, q: int, m: int) -> bool:
        """Whether most sets of this size lose no more than their slack."""
        k = size * self.cold / m
        p = [math.exp(-k) * k**i / math.factorial(i) for i in range(q + 2)]
        per = v * sum(p[: q + 1]) + (p[q + 1] if v == 2 else 0)
        return per * m + 1.6 * v * math.sqrt(per * m) <= v * m - int(self.need(size))


def _flat_segments(h: np.ndarray, doc: np.ndarray, seed: int, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, set, segment), by set and segment. h: 48-bit, sorted within a set; m: segments for each gram's set."""
    if seed:
        h = mix(h + U(seed * 0xD1B54A32D192ED03 % (1 << 64))) & _48
        order = np.argsort((doc.astype(U) << U(48)) | h)
        h, doc, m = h[order], doc[order], m[order]
    seg = ((h >> U(16)) * m.astype(U)) >> U(32)
    return h, doc, seg.astype(np.int64)


class Spread:
    """Which partition a signature goes to: each band has a range of [0, parts), as wide as its share of the text."""

    def __init__(self, mass: dict[int, int], parts: int):
        # a set signs in its own band and in the next lower one
        top = max(mass, default=0)
        share = np.array([mass.get(b, 0) + mass.get(b + 1, 0) + 1 for b in range(top + 1)], dtype=float)
        ends = np.cumsum(share) / share.sum() * parts
        self.parts, self.first, self.width = parts, np.append(0, ends[:-1]), np.diff(ends, prepend=0)

    def part(self, key: np.ndarray, band: np.ndarray) -> np.ndarray:
        b = np.minimum(band, len(self.first) - 1)
        return np.minimum((self.first[b] + (key >> U(32)).astype(float) / (1 << 32) * self.width[b]).astype(np.int64), self.parts - 1)


def signatures(h: np.ndarray, bounds: np.ndarray, plan: Plan, frequent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(key, set) of every signature. h: the distinct 48-bit grams, sorted within each set; an exact subset's key is odd, a deletion's even."""
    return _signatures(h, bounds, plan, frequent)[:2]


def _frequency(h: np.ndarray, frequent: np.ndarray | None, often: np.ndarray | None) -> np.ndarray:
    """0 for a gram that isn't frequent, else its number."""
    out = np.zeros(len(h), np.int64)
    if frequent is None or not len(frequent):
        return out
    likely = np.zeros(1 << 22, bool)
    likely[frequent & U((1 << 22) - 1)] = True
    at = np.flatnonzero(likely[h & U((1 << 22) - 1)])
    found = np.minimum(np.searchsorted(frequent, h[at]), len(frequent) - 1)
    out[at] = np.where(frequent[found] == h[at], 1 if often is None else often[found], 0)
    return out


def _signatures(h: np.ndarray, bounds: np.ndarray, plan: Plan, frequent: np.ndarray | None, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``signatures`` with the band of each. frequent: sorted grams; often: the number of each."""
    number = _frequency(h, frequent, often)
    hot = number > 0
    rare = h[~hot]
    rare_bounds = np.concatenate([[0], np.cumsum(~hot)])[bounds]
    sizes = np.diff(bounds)
    own, low = plan.band(sizes), plan.lowest(sizes)
    keys, sets, bands = [], [], []
    for b in np.unique(np.concatenate([own, low])):
        v, q, m, hi = plan.allocation(int(b))
        slack = v * m - plan.need(np.minimum(sizes, hi))
        todo = np.flatnonzero((sizes > 0) & (low <= b) & (own >= b))
        for seed in range(ROUNDS + 1) if m else (ROUNDS,):
            if not len(todo):
                break
            space = mix(np.array([(int(b) << 8) + seed + 1], dtype=U))[0]
            if seed == ROUNDS:
                n = sizes[todo]
                local = np.repeat(np.arange(len(todo)), n)
                at = _spans(bounds[todo], n)
                at = at[np.lexsort((h[at], number[at], local))]
                rank = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
                use = rank < np.repeat(n - np.ceil(n * plan.t - 1e-9).astype(np.int64) + 1, n)
                keys.append(mix(h[at[use]] ^ space) | U(1))
                sets.append(todo[local[use]])
                break
            n = np.diff(rare_bounds)[todo]
            local = np.repeat(np.arange(len(todo)), n)
            if not len(local):
                continue
            g, owner, seg = _flat_segments(rare[_spans(rare_bounds[todo], n)], local, seed, np.full(len(local), m))
            first = np.empty(len(g), bool)
            first[0] = True
            first[1:] = (owner[1:] != owner[:-1]) | (seg[1:] != seg[:-1])
            starts = np.flatnonzero(first)
            count = np.diff(np.append(starts, len(g)))
            mixed = mix(g + U(0x632BE59BD9B4E019))
            total = np.add.reduceat(mixed, starts)
            place = mix(seg[starts].astype(U) + space)
            keep = count > q
            kept = np.bincount(owner[starts[keep]], minlength=len(todo))
            loss = v * (m - kept)
            if v == 2:
                loss = loss + np.bincount(owner[starts[count == q + 1]], minlength=len(todo))
            keys.append(mix(total[keep] ^ place[keep]) | U(1))
            sets.append(todo[owner[starts[keep]]])
            if v == 2:
                which = np.repeat(np.arange(len(starts)), count)
                use = keep[which] & (count[which] > 1)
                keys.append(mix((total[which[use]] - mixed[use]) ^ place[which[use]]) & ~U(1))
                sets.append(todo[owner[use]])
            todo = todo[loss > slack[todo]]
        bands.extend([int(b)] * (len(keys) - len(bands)))
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(sets), np.repeat(np.array(bands, np.int64), [len(k) for k in keys])


def gram_sets(texts: pa.Array, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(distinct 48-bit grams, sorted within each text; bounds of the texts)."""
    h, bounds, _, _ = words(texts, seed=seed)
    g, gb = ngrams(h, bounds, n)
    doc = np.repeat(np.arange(len(gb) - 1), np.diff(gb)).astype(U)
    # texts of a chunk number fewer than 2^16 unless nearly all are tiny; those are cut again by the caller
    key = np.sort((doc << U(48)) | (g & _48))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    own = (key >> U(48)).astype(np.int64)
    return key & _48, np.searchsorted(own, np.arange(len(gb)))


def _bits(size: np.ndarray) -> np.ndarray:
    """log2 of the bits of a parity map for a set of this size: its size to twice that, 64 at least."""
    return np.maximum(6, np.ceil(np.log2(np.maximum(size, 1)) - 1e-9)).astype(np.int64)


def _parity(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The parity maps of the sets, one behind the other, as bytes: bit i is the parity of the grams whose hash ends in i."""
    size = np.diff(bounds)
    bits = np.int64(1) << _bits(size)
    base = np.cumsum(bits) - bits
    flat = np.repeat(base, size) + (h & np.repeat(bits - 1, size).astype(U)).astype(np.int64)
    return np.packbits((np.bincount(flat, minlength=int(bits.sum())) & 1).astype(np.uint8), bitorder="little")


def _spans(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes of the ranges [start, start + length), one behind the other."""
    return np.repeat(start - (np.cumsum(length) - length), length) + np.arange(length.sum())


class _Maps:
    """Parity maps of the sets of a partition. The symmetric difference of two sets is at least the number of bits in
    which their maps differ; a longer map folds by exclusive or to the length of a shorter one."""

    def __init__(self, raw: np.ndarray, size: np.ndarray, t: float):
        self.size, self.t, self.cls = size, t, _bits(size)
        # places are counted in words of 64 bits: an index for each byte would take many times the maps
        raw, length = raw.view(U), (np.int64(1) << self.cls) // 64
        start = np.cumsum(length) - length
        self.at, self.rows = {}, {}
        for c in np.unique(self.cls):
            own, up = np.flatnonzero(self.cls == c), np.flatnonzero(self.cls == c + 1)
            m = raw[_spans(start[own], length[own])].reshape(len(own), (1 << int(c)) // 64)
            u = raw[_spans(start[up], length[up])].reshape(len(up), (2 << int(c)) // 64)
            half = m.shape[1]
            at = np.full(len(size), -1, np.int64)
            at[own] = np.arange(len(own))
            at[up] = len(own) + np.arange(len(up))
            self.at[c], self.rows[c] = at, np.concatenate([m, u[:, :half] ^ u[:, half:]])

    def may_join(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        most = np.floor((1 - self.t) / (1 + self.t) * (self.size[x].astype(np.int64) + self.size[y]) + 1e-9)
        c = np.minimum(self.cls[x], self.cls[y])
        apart = np.abs(self.cls[x] - self.cls[y])
        ok = np.ones(len(x), bool)
        for k in np.unique(c):
            which = np.flatnonzero((c == k) & (apart <= 1))
            step = max(1, (4 << 20) >> int(k))
            for i in range(0, len(which), step * 8):
                w = which[i : i + step * 8]
                differ = np.bitwise_count(self.rows[k][self.at[k][x[w]]] ^ self.rows[k][self.at[k][y[w]]]).sum(axis=1)
                ok[w] = differ <= most[w]
        return ok


def _gram_parts(n: int, parts: int, seed: int):
    """The grams of texts in blocks by parts of the hash space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, grams = [], 0

        def flush() -> pa.RecordBatch:
            h = np.concatenate(held)
            part = (h % U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(parts + 1))
            h = h[order]
            some = np.flatnonzero(np.diff(cut))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([planes(h[cut[p] : cut[p + 1]], 6) for p in some], pa.binary())], ["part", "grams"])

        for batch in batches:
            texts = batch.column("text")
            for a, z in chunks(texts):
                for a2 in range(a, z, 60_000):
                    h, _ = gram_sets(texts.slice(a2, min(z, a2 + 60_000) - a2), n, seed)
                    held.append(h)
                    grams += len(h)
                    if grams >= COUNTED:
                        yield flush()
                        grams = 0
        if grams:
            yield flush()

    return run


def _often(least: float):
    """A part's grams that so many texts hold, with their number; under -1 the number of all."""

    def run(table: pa.Table) -> pa.Table:
        h = np.concatenate([unplanes(b, 6) for b in table.column("grams").to_pylist()])
        u, c = np.unique(h, return_counts=True)
        keep = c >= least
        return pa.table({"gram": np.append(u[keep].astype(np.int64), -1), "c": np.append(c[keep], len(h))})

    return run


def _frequent(slim: DataFrame, n: int, size: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray, float]:
    """(sorted frequent grams, the number of each in the sample, share of all grams that the others are). size: bytes of all documents."""
    each = max(1, min(rows // SAMPLE, round(1 / SAMPLE_SHARE)))
    least = max(SEEN, LEAST_FREQUENT / each)
    parts = max(1, math.ceil(size / each / GRAM_BYTES / COUNTED))
    texts = slim.filter("text IS NOT NULL").filter(F.expr(f"pmod(xxhash64(rid), {each}) = 0")).select("text")
    c = texts.mapInArrow(tidied_stream(_gram_parts(n, parts, seed)), "part int, grams binary").groupBy("part").applyInArrow(tidied(_often(least)), "gram bigint, c bigint")
    c = written(c, "frequent")
    most = 1 << 12
    by_number = {r.c: r.n for r in c.filter("gram >= 0").groupBy(F.least("c", F.lit(most)).alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()}
    taken = 0
    for number in sorted(by_number, reverse=True):
        taken += by_number[number]
        if taken > MOST_FREQUENT:
            least = number + 1
            break
    found = c.filter((F.col("gram") < 0) | (F.col("c") >= least)).toArrow()
    gram, count = found["gram"].to_numpy(), found["c"].to_numpy()
    total = int(count[gram < 0].sum())
    order = np.argsort(gram)[int((gram < 0).sum()) :]
    return gram[order].astype(U), count[order], 1 - int(count[order].sum()) / max(total, 1)


BLOCK = "part int, keys binary, counts binary, rids binary, sizes binary, prints binary, maps binary"


def _blocks(n: int, plan: Plan, spread: Spread, frequent: np.ndarray, often: np.ndarray, seed: int):
    """Map side: (rid, text) batches to packed blocks of signatures for each partition."""

    def flush(held: list, arrays: dict) -> pa.RecordBatch:
        key = np.concatenate([x[0] for x in held])
        doc = np.concatenate([x[1] for x in held])
        part = np.concatenate([x[2] for x in held])
        rid, size, mark, maps = (np.concatenate(arrays[k]) for k in ("rid", "size", "print", "map"))
        maps, length = maps.view(U), (np.int64(1) << _bits(size)) // 64
        start = np.cumsum(length) - length
        order = np.argsort(part.astype(np.int64) * len(rid) + doc)
        key, doc, part = key[order].astype(np.uint32), doc[order], part[order]
        cut = np.searchsorted(part, np.arange(spread.parts + 1))
        rows = []
        for p in np.flatnonzero(np.diff(cut)):
            d = doc[cut[p] : cut[p + 1]]
            at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
            who = d[at]
            count = np.diff(np.append(at, len(d)))
            # the low 32 bits of a key with its kind; the high ones chose the partition
            rows.append((int(p), key[cut[p] : cut[p + 1]].tobytes(), planes(count, 4), planes(np.diff(rid[who], prepend=0), 8), planes(size[who], 4), mark[who].tobytes(), maps[_spans(start[who], length[who])].tobytes()))
        held.clear()
        for x in arrays.values():
            x.clear()
        cols = list(zip(*rows)) if rows else [[]] * 7
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], ["part", "keys", "counts", "rids", "sizes", "prints", "maps"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, arrays, total, docs = [], {"rid": [], "size": [], "print": [], "map": []}, 0, 0
        for batch in batches:
            texts, rids = batch.column("text"), batch.column("rid").to_numpy(zero_copy_only=False)
            for a, z in chunks(texts):
                for a2 in range(a, z, 60_000):
                    z2 = min(z, a2 + 60_000)
                    h, bounds = gram_sets(texts.slice(a2, z2 - a2), n, seed)
                    size = np.diff(bounds)
                    some = np.flatnonzero(size)
                    mark = np.zeros(z2 - a2, U)
                    if len(some):
                        mark[some] = np.add.reduceat(mix(h), bounds[:-1][some])
                    key, doc, band = _signatures(h, bounds, plan, frequent, often)
                    held.append((key, (doc + docs).astype(np.int32), spread.part(key, band).astype(np.int32)))
                    arrays["rid"].append(rids[a2:z2].astype(np.int64))
                    arrays["size"].append(size)
                    arrays["print"].append(mark)
                    arrays["map"].append(_parity(h, bounds))
                    docs += z2 - a2
                    total += len(key)
                    if total >= FLUSH:
                        yield flush(held, arrays)
                        total = docs = 0
        if total:
            yield flush(held, arrays)

    return run


def _roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The root of each of ``x`` in the forest ``label``, where a root is its own; paths are shortened."""
    r = label[x]
    while True:
        up = label[r]
        if np.array_equal(up, r):
            break
        r = up
    label[x] = r
    return r


def _unite(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
    """Connect each of ``x`` with that of ``y``; the lesser root stays one."""
    while len(x):
        a, b = _roots(label, x), _roots(label, y)
        apart = np.flatnonzero(a != b)
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))


def _candidates(t: float):
    """Reduce side: the blocks of one partition to the components that its candidate pairs make, each document with one other; and
    copies (same) with their least document. A pair that others connect already is not looked at."""

    def run(table: pa.Table) -> pa.Table:
        def joined(name: str, kind) -> np.ndarray:
            """All values of a binary column, one behind the other, without a copy where the column is one piece."""
            c = table.column(name)
            c = c.chunk(0) if c.num_chunks == 1 else c.combine_chunks()
            c = c.chunk(0) if isinstance(c, pa.ChunkedArray) else c
            off = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
            return np.frombuffer(c.buffers()[2], np.uint8)[off[0] : off[-1]].view(kind)

        columns = {k: [unplanes(b, w).astype(np.int64) for b in table.column(k).to_pylist()] for k, w in (("rids", 8), ("sizes", 4), ("counts", 4))}
        rid = np.concatenate([np.cumsum(x) for x in columns["rids"]])
        size, counts = np.concatenate(columns["sizes"]), columns["counts"]
        del columns
        mark = joined("prints", np.uint8).copy().view(U)
        # documents with equal sets: only the least goes on, the others are joined to it
        order = np.lexsort((rid, size, mark))
        new = np.concatenate([[True], (mark[order][1:] != mark[order][:-1]) | (size[order][1:] != size[order][:-1])])
        lead = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
        leader = np.empty(len(rid), np.int64)
        leader[order] = lead
        twins = np.flatnonzero(rid[leader] != rid)
        a_out, b_out, same = [rid[leader[twins]]], [rid[twins]], [np.ones(len(twins), bool)]
        lead_of = np.where(rid[leader] == rid, leader, -1).astype(np.int32)
        # key and document in one integer, filled block by block and sorted in place; the kind of signature is the key's lowest bit
        both, at, first = np.empty(sum(int(c.sum()) for c in counts), U), 0, 0
        for c, keys in zip(counts, table.column("keys")):
            doc = np.repeat(lead_of[first : first + len(c)], c)
            use = doc >= 0
            to = at + int(use.sum())
            both[at:to] = np.frombuffer(keys.as_buffer(), np.uint32)[use]
            both[at:to] <<= U(32)
            both[at:to] |= doc[use].view(np.uint32)
            at, first = to, first + len(c)
        both = both[:at]
        both.sort()
        key = both.view(np.uint32)[1::2]
        same_run = (key[1:] ^ key[:-1]) < 2
        shared = np.zeros(len(key), bool)
        shared[1:] |= same_run
        shared[:-1] |= same_run
        both = both[shared]
        key, doc = (both >> U(33)).astype(np.uint32), (both & U(0xFFFFFFFF)).astype(np.int32)
        kind = (both & U(1 << 32)).astype(bool)
        del both, shared, same_run
        maps = _Maps(joined("maps", np.uint8), size, t)
        label = np.arange(len(rid))
        for at in range(0, len(key), PAIR_STEP):
            here, step = np.arange(at, min(at + PAIR_STEP, len(key))), 1
            while len(here):
                here = here[here + step < len(key)]
                here = here[key[here] == key[here + step]]
                x, y = doc[here], doc[here + step]
                small, big = np.minimum(size[x], size[y]), np.maximum(size[x], size[y])
                ok = (kind[here] | kind[here + step]) & (x != y) & (small >= np.ceil(big * t - 1e-9))
                x, y = x[ok], y[ok]
                ok = _roots(label, x) != _roots(label, y)
                x, y = x[ok], y[ok]
                ok = maps.may_join(x, y)
                _unite(label, x[ok], y[ok])
                if step >= 8 and not step & (step - 1) and len(here):
                    here = here[~_one(label, key, doc, here)]
                step += 1
        root = _roots(label, np.arange(len(rid)))
        x = np.flatnonzero(root != np.arange(len(rid)))
        a_out.append(np.minimum(rid[x], rid[root[x]]))
        b_out.append(np.maximum(rid[x], rid[root[x]]))
        same.append(np.zeros(len(x), bool))
        return pa.table({"a": np.concatenate(a_out), "b": np.concatenate(b_out), "same": np.concatenate(same)})

    return run


def _each_part(run: Callable[[pa.Table], pa.Table]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over all blocks of each partition of a task, of which ``_by_part`` makes it one."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            for p in np.unique(part).tolist():
                held.setdefault(p, []).append(batch if (part == p).all() else batch.filter(pa.array(part == p)))
        for p in sorted(held):
            yield from run(pa.Table.from_batches(held.pop(p))).to_batches()

    return out


def _by_part(blocks: DataFrame, parts: int, run: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over the blocks of each partition. A partition is a task of its own and its blocks go to Python as they are read: groups would be
    sorted in the JVM first, together with those of all partitions that fall to the same task by hash."""
    return blocks.repartitionById(parts, "part").mapInArrow(tidied_stream(_each_part(run)), schema)


def _one(label: np.ndarray, key: np.ndarray, doc: np.ndarray, here: np.ndarray) -> np.ndarray:
    """Whether all documents that have the key at a place are connected. key: sorted."""
    k, back = np.unique(key[here], return_inverse=True)
    first, last = np.searchsorted(key, k, "left"), np.searchsorted(key, k, "right")
    r = _roots(label, doc[_spans(first, last - first)])
    start = np.cumsum(last - first) - (last - first)
    return (np.minimum.reduceat(r, start) == np.maximum.reduceat(r, start))[back]


class _ExactSets:
    """Gram sets as sorted arrays of numbers, given to words and grams one after the other: equal if and only if the words are."""

    def __init__(self, n: int):
        self.n, self.words, self.short, self.grams, self.sets = n, {}, {}, [{} for _ in range(n - 1)], {}

    def add(self, who: int, text: str) -> None:
        ids = last = [self.words.setdefault(w, len(self.words)) for w in _SPLIT.split(text) if w]
        if 0 < len(ids) < self.n:
            # one gram of all words, unlike any longer one
            ids = [-1 - self.short.setdefault(tuple(ids), len(self.short))]
        else:
            for k, known in enumerate(self.grams, 1):
                ids = [known.setdefault(p, len(known)) for p in zip(ids, last[k:])]
        self.sets[who] = np.unique(np.array(ids, np.int64))

    def overlaps(self, a: int, others: list[int]) -> list[int]:
        mine, each = self.sets[a], [self.sets[b] for b in others]
        if not len(mine):
            return [0] * len(others)
        flat = np.concatenate(each)
        hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
        ends = np.cumsum([len(x) for x in each])
        total = np.concatenate([[0], np.cumsum(hit)])
        return np.diff(total[np.concatenate([[0], ends])]).tolist()


def _verify(n: int, t: float):
    """Rows by task: first its documents (text, no b), then its pairs by a. The pairs that reach t, and those called the same in any
    case, with overlap and size of the union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, sets, now, others = None, None, None, []
        out: list[tuple[int, int, bool, int, int]] = []

        def check() -> None:
            if others:
                for (b, same), both in zip(others, sets.overlaps(now, [b for b, _ in others])):
                    union = len(sets.sets[now]) + len(sets.sets[b]) - both
                    if same or both >= t * union - 1e-9:
                        out.append((now, b, same, both, union))
                others.clear()

        def rows() -> pa.RecordBatch:
            c = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["a", "b", "same", "overlap", "total"])
            out.clear()
            return batch

        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("root", "ca", "cb", "a", "b", "same")])
            text = pc.utf8_lower(batch.column("text"))
            for i, (root, ca, cb, a, b, same) in enumerate(keys):
                if task != (root, ca, cb):
                    check()
                    task, sets, now = (root, ca, cb), _ExactSets(n), None
                if b is None:
                    sets.add(a, text[i].as_py())
                    continue
                if a != now or len(others) >= 1000:
                    check()
                    now = a
                others.append((b, same))
            yield rows()
        check()
        if out:
            yield rows()

    return run


def _least_overlaps(most: int, t: float) -> np.ndarray:
    """By the sum of two sizes, up to ``most``: the least overlap that reaches the threshold."""
    s = np.arange(most + 1)
    o = np.maximum(np.floor(t * s / (1 + t)).astype(np.int64) - 1, 0)
    for _ in range(3):
        o += ~(o >= t * (s - o) - 1e-9)
    return o


def linked(left: list[np.ndarray], right: list[np.ndarray] | None, t: float, exact: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, overlap) of every two sets that reach the threshold, j counted on behind ``left``; without ``right`` i < j of one list.
    The overlap is a lower bound unless ``exact``.

    Grams that many of the sets hold are compared as bits; what the others can add bounds the overlap from above, and where that
    leaves it open they are looked up.
    """
    sets = left + (right or [])
    size = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, gram, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = held >= max(2, len(sets) / 8)
    at = np.flatnonzero(common[gram])
    width = -(-int(common.sum()) // 64) or 1
    flags = np.zeros((len(sets), width * 64), bool)
    flags[owner[at], (np.cumsum(common) - 1)[gram[at]]] = True
    bits = np.packbits(flags, axis=1).view(U)
    del flags
    # the rarer grams that two hold, in the order of (set, gram)
    at = np.flatnonzero(((held > 1) & ~common)[gram])
    rare, key = gram[at], owner[at] * len(held) + gram[at]
    rares = np.bincount(owner[at], minlength=len(sets))
    first = np.cumsum(rares) - rares
    need = _least_overlaps(int(2 * size.max()), t)

    def both_hold(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        x, y = np.where(rares[x] <= rares[y], x, y), np.where(rares[x] <= rares[y], y, x)
        out = np.zeros(len(x), np.int64)
        step = max(1, (1 << 19) // max(1, int(rares.max())))
        for i in range(0, len(x), step):
            n = rares[x[i : i + step]]
            want = rare[_spans(first[x[i : i + step]], n)] + np.repeat(y[i : i + step], n) * len(held)
            hit = key[np.minimum(np.searchsorted(key, want), len(key) - 1)] == want if len(key) else np.zeros(0, bool)
            out[i : i + step] = np.bincount(np.repeat(np.arange(len(n)), n)[hit], minlength=len(n))
        return out

    i = 0
    while i < len(left):
        j = i + 1 if right is None else len(left)
        if j >= len(sets):
            break
        to = min(len(left), i + max(1, (1 << 19) // ((len(sets) - j) * width)))
        both = np.bitwise_count(bits[i:to, None] & bits[None, j:]).sum(axis=2, dtype=np.int32)
        wanted = need[size[i:to, None] + size[None, j:]]
        x, y = np.nonzero(both + np.minimum(rares[i:to, None], rares[None, j:]) >= wanted)
        if right is None:
            x, y = x[y + j > x + i], y[y + j > x + i]
        both, wanted, x, y = both[x, y].astype(np.int64), wanted[x, y], x + i, y + j
        todo = np.flatnonzero((np.minimum(rares[x], rares[y]) > 0) & (exact | (both < wanted)))
        both[todo] += both_hold(x[todo], y[todo])
        ok = both >= wanted
        yield x[ok], y[ok], both[ok]
        i = to


_PAIRS = "a bigint, b bigint, overlap bigint, total bigint"
_LINKS = "a bigint, b bigint, sets bigint, docs bigint"


def _compare(n: int, t: float, wanted: str):
    """Rows by task: the documents of its one or two blocks, in order. wanted: "pairs", all that reach t, with overlap and size of the union; "links",
    for each document the number of its links, in sets and in documents of this many copies (b is NULL), and pairs that connect what links connect;
    "classes", only the latter, and no more is compared once all are connected."""
    names = [c.split()[0] for c in (_PAIRS if wanted == "pairs" else _LINKS).split(", ")]

    def rows(*columns: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(columns[0]), pa.int64()) if x is None else pa.array(x, pa.int64()) for x in columns], names)

    def task(found: _ExactSets, rids: list[int], blocks: list[int], copies: list[int]) -> Iterator[pa.RecordBatch]:
        rid, sets, cut = np.array(rids), [found.sets[r] for r in rids], blocks.count(blocks[0])
        left, right = sets[:cut], sets[cut:] or None
        if wanted == "pairs":
            for i, j, both in linked(left, right, t, True):
                size = np.array([len(x) for x in sets])
                yield rows(rid[i], rid[j], both, size[i] + size[j] - both)
            return
        number, each, label = np.zeros((2, len(rid))), np.array(copies, float), np.arange(len(rid))
        for i, j, _ in linked(left, right, t, False):
            _unite(label, i, j)
            if wanted == "classes":
                if not _roots(label, np.arange(len(rid))).any():
                    break
                continue
            for x, y in ((i, j), (j, i)):
                number[0] += np.bincount(x, minlength=len(rid))
                number[1] += np.bincount(x, each[y], len(rid))
        some = np.flatnonzero(number[0])
        yield rows(rid[some], None, number[0, some].astype(np.int64), number[1, some].astype(np.int64))
        root = _roots(label, np.arange(len(rid)))
        some = np.flatnonzero(root != np.arange(len(rid)))
        yield rows(rid[root[some]], rid[some], None, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, found, rids, blocks, copies = None, None, [], [], []
        for batch in batches:
            keys = zip(*[batch.column(c).to_pylist() for c in ("root", "ca", "cb", "c", "rid", "copies")])
            text = pc.utf8_lower(batch.column("text"))
            for i, (root, ca, cb, c, rid, k) in enumerate(keys):
                if now != (root, ca, cb):
                    if rids:
                        yield from task(found, rids, blocks, copies)
                    now, found, rids, blocks, copies = (root, ca, cb), _ExactSets(n), [], [], []
                found.add(rid, text[i].as_py())
                rids.append(rid)
                blocks.append(c)
                copies.append(k)
        if rids:
            yield from task(found, rids, blocks, copies)

    return run


def _in_blocks(tree: DataFrame, slim: DataFrame) -> DataFrame:
    """(rid, root, c) of all vertices of ``tree`` (rid, root), roots too: c numbers the blocks of about VERIFY_BYTES of text of a root."""
    member = tree.unionByName(tree.select(F.col("root").alias("rid"), "root").distinct())
    member = join_rows(slim.select("rid", F.octet_length("text").cast("bigint").alias("bytes")), member, "rid")
    upto = F.sum("bytes").over(Window.partitionBy("root").orderBy("rid").rowsBetween(Window.unboundedPreceding, -1))
    return member.withColumn("c", F.floor(F.coalesce(upto, F.lit(0)) / VERIFY_BYTES).cast("int")).drop("bytes")


def _verified(found: DataFrame, slim: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, same, overlap, total) of copies ``found``, each b with its least document a."""
    member = written(_in_blocks(found.select(F.col("b").alias("rid"), F.col("a").alias("root")), slim), "pair-blocks")
    left = member.select(F.col("rid").alias("a"), "root", F.col("c").alias("ca"))
    right = member.select(F.col("rid").alias("b"), F.col("c").alias("cb"))
    pairs = written(found.join(left, "a").join(right, "b").select("root", "ca", "cb", "a", "b", "same"), "pair-tasks")
    need = written(pairs.select("root", "ca", "cb", "a").union(pairs.select("root", "ca", "cb", "b")).distinct().withColumnRenamed("a", "rid"), "pair-needs")
    none = F.lit(None)
    texts = join_rows(slim, need, "rid").select("root", "ca", "cb", F.col("rid").alias("a"), none.cast("bigint").alias("b"), none.cast("boolean").alias("same"), "text")
    tasks = texts.unionByName(pairs.withColumn("text", none.cast("string"))).repartition("root", "ca", "cb")
    tasks = tasks.sortWithinPartitions("root", "ca", "cb", F.col("b").isNotNull(), "a", "b")
    return tasks.mapInArrow(tidied_stream(_verify(n, threshold)), "a bigint, b bigint, same boolean, overlap bigint, total bigint")


def _compared(edges: DataFrame, twins: DataFrame, slim: DataFrame, n: int, threshold: float, wanted: str) -> DataFrame:
    """What ``_compare`` finds in each component of ``edges`` (a, b) of least documents; twins: (a, b), each further document with its set's least."""
    member = _in_blocks(components(edges), slim)
    copies = twins.groupBy(F.col("a").alias("rid")).agg((F.count(F.lit(1)) + 1).alias("copies"))
    member = written(member.join(copies, "rid", "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("bigint"))), "blocks")
    last = member.groupBy("root").agg(F.max("c").alias("last"))
    # a block meets itself and each other block of its component
    need = member.join(last, "root").withColumn("k", F.explode(F.expr("sequence(0, last)")))
    need = written(need.select("root", F.least("c", "k").alias("ca"), F.greatest("c", "k").alias("cb"), "c", "rid", "copies"), "block-needs")
    tasks = join_rows(slim, need, "rid").repartition("root", "ca", "cb").sortWithinPartitions("root", "ca", "cb", "c", "rid")
    tasks = tasks.select("root", "ca", "cb", "c", "rid", "copies", "text")
    return tasks.mapInArrow(tidied_stream(_compare(n, threshold, wanted)), _PAIRS if wanted == "pairs" else _LINKS)


def _sizes(slim: DataFrame, threshold: float) -> tuple[dict[int, int], int, int]:
    """({band by bytes: bytes}, bytes, rows) of all documents."""
    n = F.octet_length("text").cast("bigint")
    band = F.floor(F.ln(F.greatest(n / GRAM_BYTES, F.lit(1.0))) / math.log(1 / threshold)).cast("int")
    # as many rows as there are bands: the logarithm of the longest text
    found = slim.groupBy(F.coalesce(band, F.lit(0)).alias("b")).agg(F.coalesce(F.sum(n), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("c")).collect()
    return {r.b: int(r.n) for r in found}, sum(int(r.n) for r in found), sum(r.c for r in found)


def _twins_and_compared(keyed: DataFrame, n: int, threshold: float, wanted: str, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Over the rids of ``keyed`` (row, rid): (a, b) of each set's least document and each further one, and what ``_compare`` finds among the
    least documents of distinct sets."""
    small_batches(keyed.sparkSession)
    slim = keyed.select("rid", F.col("row").getField("text").alias("text"))
    mass, size, rows = _sizes(slim, threshold)
    frequent, often, cold = _frequent(slim, n, size, rows, seed)
    plan = Plan(threshold, rows, cold, OVERLAP)
    spread = Spread(mass, max(1, math.ceil(size / PARTITION_BYTES)))
    blocks = slim.filter("text IS NOT NULL").mapInArrow(tidied_stream(_blocks(n, plan, spread, frequent, often, seed)), BLOCK)
    found = _by_part(blocks, spread.parts, _candidates(threshold), "a bigint, b bigint, same boolean")
    # copies and pairs are reported by several partitions; a copy's least leader over all of them is its own
    found = written(found.distinct(), "candidates")
    twins = written(_verified(found.filter("same"), slim, n, threshold), "copies")
    if twins.filter("overlap < total").limit(1).count():
        return _twins_and_compared(keyed, n, threshold, wanted, seed + 1)
    twins = twins.select("a", "b")
    return twins, written(_compared(found.filter("NOT same").select("a", "b"), twins, slim, n, threshold, wanted), "compared")


def _twins_and_near(keyed: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(a, b) of each set's least document and each further one, and (a, b, millionths) of the least documents of distinct sets, a < b;
    the similarity in millionths, rounded down."""
    twins, found = _twins_and_compared(keyed, n, threshold, "pairs")
    return twins, found.select("a", "b", F.expr("overlap * 1000000 div total").alias("millionths"))


def _classes(keyed: DataFrame, n: int, threshold: float, wanted: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rid, root) of the classes but for the roots, copies (a, b) as above, and (a, sets, docs) of the documents that have
    links to other sets, where "links" are wanted."""
    twins, found = _twins_and_compared(keyed, n, threshold, wanted)
    tree = components(found.filter("b IS NOT NULL").select("a", "b").union(twins))
    return tree, twins, found.filter("b IS NULL").groupBy("a").agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))


def _pairs(keyed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, millionths) over rids, a < b: distinct sets by their least documents, and each further document with its set's least."""
    twins, near = _twins_and_near(keyed, n, threshold)
    return twins.withColumn("millionths", F.lit(1_000_000).cast("bigint")).unionByName(near)


def _all_pairs(keyed: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, millionths) over rids, a < b, of every two documents that reach the threshold."""
    twins, near = _twins_and_near(keyed, n, threshold)
    # every document of a set that has several, by the set's least one, with its number in the set
    member = twins.select(F.col("a").alias("lead"), F.col("b").alias("rid")).union(twins.select("a", "a").distinct())
    member = member.withColumn("i", F.row_number().over(Window.partitionBy("lead").orderBy("rid")) - 1)
    member = written(member.withColumn("blocks", F.expr(f"(max(i) OVER (PARTITION BY lead)) div {EXPAND_BLOCK} + 1")), "members")
    # the pairs of a large set are made by many tasks: each block of its members meets all of them
    left = member.select("lead", F.expr(f"i div {EXPAND_BLOCK}").alias("block"), F.col("rid").alias("a"))
    right = member.select("lead", F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"), F.col("rid").alias("b"))
    equal = left.join(right, ["lead", "block"]).filter("a < b").select("a", "b", F.lit(1_000_000).cast("bigint").alias("millionths"))
    for side in ("a", "b"):
        copies = member.select(F.col("lead").alias(side), F.col("rid").alias(f"{side}_rid"))
        near = near.join(copies, side, "left").withColumn(side, F.coalesce(f"{side}_rid", side)).drop(f"{side}_rid")
    return equal.unionByName(near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "millionths"))


def similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, millionths): every pair of distinct gram sets that reaches the threshold, by the least document of
    each set, and each further document of a set with that least document. ``millionths`` is the similarity."""
    keyed, kind = with_row_id(docs)
    return _named(_pairs(keyed, n, threshold), keyed, kind)


def all_similar_pairs(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, millionths): every pair of documents that reaches the threshold, copies of one set with each other and with all
    near partners of the set included. The result grows with the square of a group of copies."""
    keyed, kind = with_row_id(docs)
    return _named(_all_pairs(keyed, n, threshold), keyed, kind)


def linked_documents(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row for each of ``docs``: (doc_id, set_id, class_id, set_links, links).

    ``set_id`` is the least document of equal grams, ``class_id`` the least document of those that links connect, ``set_links`` the number of
    other sets that reach the threshold with the document's, ``links`` the number of other documents that reach it, copies included. A document
    without words is a set and class of its own. Where ids repeat or are NULL, rows are documents of their own, and set_id and class_id are row
    numbers in the order of ids instead, since an id would not tell classes apart.
    """
    keyed, kind = with_row_id(docs)
    tree, twins, links = _classes(keyed, n, threshold, "links")
    tree = tree.unionByName(tree.select(F.col("root").alias("rid"), "root").distinct())
    tree = tree.join(twins.select(F.col("b").alias("rid"), F.col("a").alias("lead")), "rid", "left").withColumn("lead", F.coalesce("lead", "rid"))
    copies = twins.groupBy(F.col("a").alias("lead")).agg(F.count(F.lit(1)).alias("copies"))
    tree = tree.join(copies, "lead", "left").join(links.withColumnRenamed("a", "lead"), "lead", "left")
    zero = F.lit(0).cast("bigint")
    tree = tree.select("rid", "lead", "root", F.coalesce("sets", zero).alias("sets"), (F.coalesce("docs", zero) + F.coalesce("copies", zero)).alias("docs"))
    ids = keyed.select("rid", F.col("rid" if kind == "clean" else "row.doc_id").cast("bigint").alias("doc_id"))
    return ids.join(tree, "rid", "left").select(
        "doc_id", F.coalesce("lead", "rid").alias("set_id"), F.coalesce("root", "rid").alias("class_id"), F.coalesce("sets", zero).alias("set_links"), F.coalesce("docs", zero).alias("links")
    )


def _named(pairs: DataFrame, keyed: DataFrame, kind: str) -> DataFrame:
    """``pairs`` of rids with the documents' ids."""
    if kind == "clean":
        return pairs.select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), "millionths")
    ids = keyed.select("rid", F.col("row").getField("doc_id").alias("d"))
    out = pairs.join(ids.select(F.col("rid").alias("a"), F.col("d").alias("doc_a")), "a").join(ids.select(F.col("rid").alias("b"), F.col("d").alias("doc_b")), "b")
    return out.filter("NOT doc_a <=> doc_b").select("doc_a", "doc_b", "millionths").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(rid, root) for every vertex of ``edges`` (a, b) but the roots: root is the component's least vertex.

    Alternating large-star and small-star steps; each step's edges are written to the shared folder. The number of
    steps grows with the logarithm of the component, not with the data.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = _state(e)
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = written(small.filter("u <> v").distinct(), "edges")
        now = _state(e)
        if now == before:
            return e.select(F.col("u").alias("rid"), F.col("v").alias("root"))
        before = now


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def drop_near_duplicates(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document, the least by doc_id, of each group that pairs connect, in its own columns."""
    keyed, _ = with_row_id(docs)
    drop = _classes(keyed, n, threshold, "classes")[0].select("rid")
    return unpacked(drop_rows(keyed, drop, "rid"), docs.columns)
