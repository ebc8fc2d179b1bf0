"""Exact n-gram Jaccard join by universe partitioning and the pigeonhole rule.

A document is its set of word shingles. Sets of sizes x and y can only reach
Jaccard p / q if they differ in at most H = floor((x + y)(q - p) / (q + p))
shingles, so of any H + 1 disjoint parts of the universe one holds the same
shingles in both.

* Size bands. Sizes are cut into bands, each with its own partition of the
  shingle universe (by hash) into segments. A set is entered in its own band, and
  in every further one where a partner could lie.
* Segment subsets. A set enters only the first H + 1 of its *eligible* segments.
  Eligible is a property of a segment's content alone (so equal segments are
  eligible on both sides): at least ``least`` shingles that are not common in the
  corpus. Sets with too few eligible segments enter them all, and then again
  under weaker rules (one rare shingle is enough; common shingles count; empty
  segments count, of which there are always enough). If either set of a pair has
  enough segments, the pair meets under that rule; if neither has, both go on.
* One-deletion neighbourhoods. Where H <= 2 m - 1 for m segments, some segment
  differs by at most one shingle; entering each segment and all its
  one-deletions finds it.
* Cost-based allocation. Per band, the number of rows and the expected accidental
  meetings choose between segment subsets and deletions. The meetings follow from
  the number of sets in the band and from how many other sets hold a set's
  shingle, both measured over the corpus.

Copies (SHA-256 of the lower-cased words) are one node from the start; equal sets
of other words become one after a comparison of their words. Entries meet by hash
in bounded buckets, after tasks have combined their own: a task sends one entry
per signature, so a signature that a third of all documents share stays small.

Groups that meet are settled without all their pairs. One member, the pivot, is
compared with the others. Large groups that overlap share one, the heaviest that
any of their members met, so that few families come of them. A group of up to
``SMALL`` members (``ANEW`` times that among those entered anew) that is still in several
components then compares those of different components. A larger one is entered anew, by what tells its members from the pivot: let D_x count the
shingles in which x and the pivot differ. Two members differ in D_x + D_y less
twice the differences they share, so if at least one is not linked to the pivot
(if both are, nothing is left to find), they must share
ceil((D_x + D_y - H) / 2) >= 1 of them. Each difference is a segment of one
shingle; a member enters only as many of its first that one has to be met, per
band of the partner's D. Differences that more than ``FREQUENT`` of the members
have come last, so what meets again is at most that share of the group. These
are new groups, without the pivot, and are settled in the same way.

Pairs are first held against histograms of the shingle hashes, whose distance is
a lower bound of the true one; what may be similar is verified on the words of
the whole texts, never on hashes.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulant.llm.common import SPACES, discard, lowered, materialise, mix64, partitions, text_parts, word_codes

BAND_RATIO = 1.5
#: A shingle is common if about this share of documents has it. This bounds the list of them; groups of rarer ones are entered anew.
COMMON = 0.005
#: Groups of up to so many members may compare all their pairs.
SMALL = 128
#: So many times larger may they be where they were entered anew: members of one difference mostly share further ones, so entering such groups again would multiply them.
ANEW = 32
#: Cells of sketches compared at once.
CELLS = 1 << 22
#: Share of a group's members beyond which a difference from the pivot is entered last. Bounds the list of such differences.
FREQUENT = 0.01
#: Bands of the number of differences from a pivot.
DIFFERENCE_RATIO = 1.25
#: Tables of links, labels and members up to so many rows (some 5 MB) are worked on by one task.
FEW_LINKS = 200_000
CHUNK_SHINGLES = 1_500_000
BATCH_BYTES = 6_000_000
BUCKET_BYTES = 24 << 20
#: In the cost model: what a compared pair costs, in index rows.
PAIR_ROWS = 4.0
#: Sets below this have too few shingles for segments that are never empty.
LEAST_SEGMENTED = 32
_G = np.uint64(0x9E3779B97F4A7C15)


# --- sets -----------------------------------------------------------------


def shingle_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, codes, offsets = word_codes(lowered(texts))
    hashed = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), dtype=np.uint64, count=len(words))
    h = hashed[codes] if len(codes) else np.empty(0, dtype=np.uint64)
    rolled = np.full(max(0, len(h) - n + 1), np.uint64(n))
    for k in range(n):
        rolled = mix64(rolled * _G + h[k : len(h) - n + 1 + k])
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            out.append(np.unique(rolled[a : b - n + 1]))
        elif b > a:
            one = np.uint64(1_000_003 * (b - a))
            for x in h[a:b]:
                one = mix64(np.array([one], dtype=np.uint64) * _G + x)[0]
            out.append(np.array([one], dtype=np.uint64))
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def exact_shingles(text: str, n: int) -> set[tuple[bytes, ...]]:
    """The same set, of words: what verification compares."""
    words = bytes.lower(text.encode()).split()  # bytes: only A-Z change, only ASCII white space splits
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*(words[k:] for k in range(n))))


def similar(a: set, b: set, p: int, q: int) -> bool:
    both = len(a & b)
    return q * both >= p * (len(a) + len(b) - both)


# --- allocation -----------------------------------------------------------


@dataclass(frozen=True)
class Band:
    low: int
    high: int
    segments: int
    least: int  # shingles of an eligible segment; 0: one-deletion neighbourhoods


def differing(size: int, p: int, q: int) -> int:
    """The most shingles in which a set of this size and a similar one can differ."""
    return (size + size * q // p) * (q - p) // (q + p)


def _at_least(mean: float, k: int) -> float:
    return 1 - sum(math.exp(-mean) * mean**i / math.factorial(i) for i in range(k))


def _segments(low: int, high: int, p: int, q: int) -> tuple[int, int]:
    """The longest eligible segments of which sets of the band still have enough, and the number of segments."""
    for least in (5, 4, 3, 2):
        for m in range(differing(high, p, q) + 1, 3 * high, max(1, high // 50)):
            if all(m * _at_least(s / m, least) >= 1.05 * (differing(s, p, q) + 1) + 1 for s in (low, high)):
                return m, least
    return max(2 * (differing(high, p, q) + 1) + 2, 4), 1


def plan_bands(largest: int, counts: dict[int, int], p: int, q: int, shared: float = 1e-4) -> list[Band]:
    """Bands for sets of up to ``largest`` shingles; ``counts``: sets by floor(4 log2 size); ``shared``: of other sets, how many hold a set's shingle."""
    low = next(s for s in range(1, largest + 2) if differing(s, p, q) >= 1 or s > largest)
    bands = []
    while low <= largest:
        high = max(low, int(low * BAND_RATIO))
        while high > low and differing(low, p, q) <= 1 < differing(high, p, q):
            high -= 1  # sets that differ in one shingle have a band of their own
        n = sum(c for b, c in counts.items() if low <= 2 ** ((b + 1) / 4) and 2 ** (b / 4) <= high)
        m, least = _segments(low, high, p, q)
        need = differing(high, p, q) + 1
        cost = need * (1 + PAIR_ROWS * n * shared**least)
        parts = (need + 1) // 2
        cost_deletions = (parts + high) * (1 + PAIR_ROWS * n * shared ** max(0.0, low / parts - 1))
        bands.append(Band(low, high, parts, 0) if low < LEAST_SEGMENTED or cost_deletions < cost else Band(low, high, m, least))
        low = high + 1
    return bands


def signatures(h: np.ndarray, bands: list[Band], lows: np.ndarray, common: np.ndarray, p: int, q: int) -> np.ndarray:
    """The signatures of one set: pairs of similar, unequal sets share at least one."""
    size = len(h)
    # A set too small to differ from a similar one is in no band of its own, but a partner may be.
    own, last = (int(np.searchsorted(lows, s, side="right")) - 1 for s in (size, size * q // p))
    places = range(max(own, 0), last + 1) if size else []
    if not len(places):
        return np.empty(0, dtype=np.uint64)
    need = differing(size, p, q) + 1
    rare = None
    out = []
    for k in places:
        band = bands[k]
        salted = mix64(h + np.uint64((k + 1) * int(_G) % 2**64))
        seg = (salted >> np.uint64(33)) % np.uint64(band.segments)
        order = np.argsort(seg, kind="stable")
        seg_sorted, value = seg[order], mix64(salted[order] ^ _G)
        first = np.flatnonzero(np.concatenate([[True], seg_sorted[1:] != seg_sorted[:-1]]))
        ids, sums = seg_sorted[first], np.add.reduceat(value, first)

        def named(ids: np.ndarray, sums: np.ndarray, rule: int, k: int = k) -> np.ndarray:
            return mix64(sums * _G + mix64(ids * np.uint64(16) + np.uint64(rule) + np.uint64(k + 1) * np.uint64(1 << 40)))

        if band.least == 0:
            every = np.arange(band.segments, dtype=np.uint64)
            full = np.zeros(band.segments, dtype=np.uint64)
            full[ids.astype(np.int64)] = sums
            out += [named(every, full, 5), named(seg_sorted, full[seg_sorted.astype(np.int64)] - value, 5)]
            continue
        counts = np.diff(np.append(first, size))
        if rare is None:
            at = np.searchsorted(common, h)
            rare = (common[np.minimum(at, len(common) - 1)] != h) if len(common) else np.ones(size, dtype=bool)
        rare_counts = np.add.reduceat(rare[order].astype(np.int64), first)
        for rule, good in enumerate((rare_counts >= band.least, rare_counts >= 1, counts >= band.least, counts >= 1)):
            found = np.flatnonzero(good)[:need]
            out.append(named(ids[found], sums[found], rule))
            if len(found) == need:
                break
        else:
            # Empty segments count: there are more segments than shingles that may differ.
            full = np.zeros(band.segments, dtype=np.uint64)
            full[ids.astype(np.int64)] = sums
            out.append(named(np.arange(need, dtype=np.uint64), full[:need], 4))
    return np.concatenate(out)


# --- passes over the texts ------------------------------------------------

_LIGHT = "kind int, doc_id long, n_shingles long, k1 long, k2 long, words binary, sketch binary"
_LIGHT_SCHEMA = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("words", pa.binary()), ("sketch", pa.binary())])


def _signed(x) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def _set_keys(sets: list[np.ndarray], key_bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    one = np.array([np.add.reduce(mix64(s)) if len(s) else 0 for s in sets], dtype=np.uint64)
    two = np.array([np.add.reduce(mix64(s ^ _G) * _G) if len(s) else 0 for s in sets], dtype=np.uint64)
    return one >> np.uint64(64 - key_bits), two >> np.uint64(64 - key_bits)


def sketch(h: np.ndarray) -> bytes:
    """Histogram of shingle hashes, about as many cells as shingles: cells are capped at 255, so distances only shrink."""
    bits = min(12, max(5, (len(h) - 1).bit_length()))
    return np.minimum(np.bincount((h >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def apart(a: bytes, b: bytes) -> int:
    """A lower bound of the number of shingles in which the sets of two sketches differ."""
    x, y = (np.frombuffer(s, dtype=np.uint8).astype(np.int64) for s in (a, b))
    while len(x) > len(y):
        x = x[0::2] + x[1::2]
    while len(y) > len(x):
        y = y[0::2] + y[1::2]
    return int(np.abs(x - y).sum())


def _measure(n: int, key_bits: int):
    """Kind 0: id, size, 128-bit key and sketch of each set, digest of its words. Kind 1: shingles often met in a chunk,
    with counts. Kind 2: (shingles of other sets that meet a set's, those that could)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def common() -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            often = counts >= max(4, 2 * COMMON * len(held))
            met, could = (counts[~often] * (counts[~often] - 1)).sum(), counts[~often].sum() * (len(held) - 1)
            values, counts = values[often], counts[often]
            kinds = np.append(np.ones(len(values), dtype=np.int32), np.int32(2))
            n_shingles, k1 = np.append(counts, met).astype(np.int64), np.append(_signed(values), could).astype(np.int64)
            none = pa.nulls(len(kinds), pa.int64())
            blank = pa.nulls(len(kinds), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(kinds), none, pa.array(n_shingles), pa.array(k1), none, blank, blank], schema=_LIGHT_SCHEMA)

        for batch in batches:
            for part in text_parts(batch, "text", BATCH_BYTES):
                texts = part.column("text")
                sets = shingle_sets(texts, n)
                one, two = _set_keys(sets, key_bits)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                plain = pc.ascii_trim_whitespace(pc.replace_substring_regex(lowered(texts), SPACES, " "))
                digests = [hashlib.sha256(t.as_buffer()).digest() for t in plain]
                columns = [pa.array(np.zeros(len(sets), dtype=np.int32)), part.column("doc_id").cast(pa.int64()), pa.array(sizes), pa.array(_signed(one)), pa.array(_signed(two))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.binary()), pa.array([sketch(s) if len(s) else None for s in sets], pa.binary())], schema=_LIGHT_SCHEMA)
                held += [s for s in sets if len(s)]
                size += int(sizes.sum())
                if size >= CHUNK_SHINGLES:
                    yield common()
                    held, size = [], 0
        if held:
            yield common()

    return run


_ENTRIES = "bucket int, sent boolean, sigs binary, keys binary, several binary"
_ENTRY_SCHEMA = pa.schema([("bucket", pa.int32()), ("sent", pa.bool_()), ("sigs", pa.binary()), ("keys", pa.binary()), ("several", pa.binary())])


def _grouped(sigs: np.ndarray, keys: np.ndarray, several: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (signature, key), sorted; starts of signatures; whether each has several keys."""
    order = np.lexsort((keys, sigs))
    sigs, keys, several = sigs[order], keys[order], several[order]
    new_sig = np.concatenate([[True], sigs[1:] != sigs[:-1]])
    new = new_sig | np.concatenate([[True], keys[1:] != keys[:-1]])
    marks = np.maximum.reduceat(several, np.flatnonzero(new))
    sigs, keys, new_sig = sigs[new], keys[new], new_sig[new]
    first = np.flatnonzero(new_sig)
    sizes = np.diff(np.append(first, len(sigs)))
    many = (sizes > 1) | (np.maximum.reduceat(marks, first) > 0)
    return sigs, keys, new_sig, np.repeat(many, sizes)


class _Entries:
    """Collects (signature, key) pairs of a task and packs them by bucket."""

    def __init__(self, buckets: int):
        self._buckets = buckets
        self._sigs: list[np.ndarray] = []
        self._keys: list[np.ndarray] = []
        self.size = 0

    def add(self, sigs: np.ndarray, key: np.uint64) -> None:
        if len(sigs):
            self._sigs.append(sigs)
            self._keys.append(np.full(len(sigs), key, dtype=np.uint64))
            self.size += len(sigs)

    def flush(self) -> pa.RecordBatch:
        sigs, keys = np.concatenate(self._sigs), np.concatenate(self._keys)
        self._sigs, self._keys, self.size = [], [], 0
        sigs, keys, first, many = _grouped(sigs, keys, np.zeros(len(sigs), dtype=np.uint8))
        rows: list[tuple] = []
        # One entry of each signature is sent to its bucket; the rest of a signature
        # that already has several keys here is known to meet, and spread evenly.
        for sent, mask in ((True, first), (False, ~first)):
            s, k, m = sigs[mask], keys[mask], many[mask].astype(np.uint8)
            place = ((s if sent else mix64(k)) % np.uint64(self._buckets)).astype(np.int32)
            order = np.argsort(place, kind="stable")
            s, k, m, place = s[order], k[order], m[order], place[order]
            cuts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else []
            for a, b in zip(cuts, [*cuts[1:], len(place)]):
                rows.append((int(place[a]), sent, s[a:b].tobytes(), k[a:b].tobytes(), m[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _ENTRY_SCHEMA)], schema=_ENTRY_SCHEMA)


def _enter(n: int, bands: list[Band], common: np.ndarray, p: int, q: int, buckets: int, key_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lows = np.array([b.low for b in bands], dtype=np.int64)
        entries = _Entries(buckets)
        for batch in batches:
            for part in text_parts(batch, "text", BATCH_BYTES):
                sets = shingle_sets(part.column("text"), n)
                one, _ = _set_keys(sets, key_bits)
                for key, h in zip(one, sets):
                    entries.add(signatures(h, bands, lows, common, p, q), key)
                if entries.size >= CHUNK_SHINGLES:
                    yield entries.flush()
        if entries.size:
            yield entries.flush()

    return run


def _meet(entries: pa.Table) -> pa.Table:
    """Members of the signatures that several keys have."""
    sent = entries.column("sent").to_numpy()
    blobs = {c: entries.column(c).to_pylist() for c in ("sigs", "keys", "several")}

    def joined(column: str, which: bool, dtype) -> np.ndarray:
        return np.frombuffer(b"".join(x for x, s in zip(blobs[column], sent) if s == which), dtype=dtype)

    sigs, keys = joined("sigs", False, np.uint64), joined("keys", False, np.uint64)
    if sent.any():
        s, k, _, many = _grouped(joined("sigs", True, np.uint64), joined("keys", True, np.uint64), joined("several", True, np.uint8))
        sigs, keys = np.concatenate([sigs, s[many]]), np.concatenate([keys, k[many]])
    return pa.table({"sig": pa.array(_signed(sigs)), "k1": pa.array(_signed(keys))})


# --- differences from a pivot ------------------------------------------------


def differences(h: np.ndarray, pivot: np.ndarray, common: np.ndarray) -> np.ndarray:
    """What tells a set from the pivot's, in an order that puts the less frequent first: shingles of its own, then those it lacks, and common ones last."""
    more, less = np.setdiff1d(h, pivot, assume_unique=True), np.setdiff1d(pivot, h, assume_unique=True)
    often = np.isin(more, common)
    return np.concatenate([more[~often], mix64(less ^ _G), more[often]])


def _difference_band(d: int) -> int:
    return math.floor(math.log(d) / math.log(DIFFERENCE_RATIO))


def entered_differences(d: int, size: int, pivot: int, is_linked: bool, p: int, q: int) -> list[tuple[int, int]]:
    """(band of the partner's differences, how many of its own first differences a set has to enter for it).

    ``d`` of its shingles differ from the pivot's. Where the set is linked to the
    pivot, only partners that are not matter.
    """
    most = differing(size, p, q)
    low = max(1, d - most)
    if is_linked:
        low = max(low, (-(-size * p // q) + pivot) * (q - p) // (q + p) + 1)
    out = []
    for band in range(_difference_band(low), _difference_band(d + most) + 1) if d and low <= d + most else []:
        least = max(low, math.floor(DIFFERENCE_RATIO**band * (1 - 1e-9)))
        enter = d - max(1, (d + least - most + 1) // 2) + 1
        if enter > 0:
            out.append((band, enter))
    return out


_OFTEN = "family long, salt int, n long, xs array<long>, cs array<long>"
_OFTEN_SCHEMA = pa.schema([("family", pa.int64()), ("salt", pa.int32()), ("n", pa.int64()), ("xs", pa.list_(pa.int64())), ("cs", pa.list_(pa.int64()))])


def _often_in_chunk(share: float):
    """Per family and chunk of rows: differences that at least half the share of its rows have, with counts. At most 2 / share rows' worth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size, salt = 0, TaskContext.get().partitionId() % 32

        def flush() -> pa.RecordBatch:
            rows = []
            for family, own in held.items():
                xs, cs = np.unique(np.concatenate(own), return_counts=True)
                rows.append((family, salt, len(own), xs[2 * cs >= share * len(own)], cs[2 * cs >= share * len(own)]))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _OFTEN_SCHEMA)], schema=_OFTEN_SCHEMA)

        for batch in batches:
            differ = batch.column("differ")
            for i, family in enumerate(batch.column("family").to_pylist()):
                held.setdefault(family, []).append(differ[i].values.to_numpy())
                size += len(held[family][-1])
            if size >= CHUNK_SHINGLES:
                yield flush()
                size = 0
        if held:
            yield flush()

    return run


def _often_in_all(share: float, least: int):
    """The sums of such counts that are at least that share of the family's rows, and more than ``least``."""

    def run(chunks: pa.Table) -> pa.Table:
        n = sum(chunks.column("n").to_pylist())
        xs, at = np.unique(np.concatenate([x.values.to_numpy() for x in chunks.column("xs")]), return_inverse=True)
        cs = np.bincount(at, weights=np.concatenate([x.values.to_numpy() for x in chunks.column("cs")])).astype(np.int64)
        kept = (cs >= share * n) & (cs > least)
        row = (chunks.column("family")[0].as_py(), chunks.column("salt")[0].as_py(), n, xs[kept], cs[kept])
        return pa.table([pa.array([x], type=f.type) for x, f in zip(row, _OFTEN_SCHEMA)], schema=_OFTEN_SCHEMA)

    return run


def _enter_differences(p: int, q: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        entries = _Entries(buckets)
        for batch in batches:
            family = mix64(batch.column("family").to_numpy().view(np.uint64) ^ _G)
            keys = batch.column("b").to_numpy().view(np.uint64)
            found, last = batch.column("differ"), batch.column("frequent")
            for i, (d, size, pivot, is_linked) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("d", "nb", "na", "linked")))):
                plan = entered_differences(d, size, pivot, is_linked, p, q)
                if not plan:
                    continue
                first = found[i].values.to_numpy().view(np.uint64)
                if last[i].is_valid:
                    late = np.isin(first, last[i].values.to_numpy().view(np.uint64))
                    first = np.concatenate([first[~late], first[late]])
                own = _difference_band(d)
                for band, enter in plan:
                    low, high = sorted((own, band))
                    entries.add(mix64(first[:enter] * _G + mix64(family[i : i + 1] + np.uint64((low << 20) + high))), keys[i])
            if entries.size >= CHUNK_SHINGLES:
                yield entries.flush()
        if entries.size:
            yield entries.flush()

    return run


# --- verification and components ------------------------------------------


def _plausible(p: int, q: int):
    """Pairs whose sketches don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = (na + nb) * (q - p) // (q + p)
            far = np.fromiter(map(apart, batch.column("sketch_a").to_pylist(), batch.column("sketch_b").to_pylist()), dtype=np.int64, count=len(na))
            yield batch.select(["a", "b"]).filter(pa.array(far <= most))

    return run


def _folded(sketches: list[bytes]) -> np.ndarray:
    """Sketches as rows of the shortest one's length."""
    least = min(map(len, sketches))
    return np.stack([np.frombuffer(s, dtype=np.uint8).reshape(least, -1).sum(axis=1, dtype=np.int32) for s in sketches])


def _plausible_in_groups(p: int, q: int):
    """Rows sorted by sig, a bounded group at a time: pairs of different components whose sketches don't rule them out."""

    def pairs(rows: list[tuple]) -> tuple[list[int], list[int]]:
        # Of two members in different components, one is not in the largest: those come first and are held against all after them.
        names, at, counts = np.unique([r[2] for r in rows], return_inverse=True, return_counts=True)
        largest = at == np.argmax(counts)
        _, ids, comps, sizes, sketches = zip(*[rows[i] for i in np.argsort(largest, kind="stable")])
        ids, comps, sizes, cells = np.array(ids), np.array(comps), np.array(sizes), _folded(sketches)
        step = max(1, CELLS // cells.shape[1])
        left: list[int] = []
        right: list[int] = []
        for i in range(len(rows) - int(largest.sum())):
            n, m = sizes[i], sizes[i + 1 :]
            every = np.flatnonzero((comps[i + 1 :] != comps[i]) & (q * n >= p * m) & (q * m >= p * n)) + i + 1
            for fit in (every[k : k + step] for k in range(0, len(every), step)):
                near = fit[np.abs(cells[fit] - cells[i]).sum(axis=1) <= (sizes[fit] + n) * (q - p) // (q + p)]
                left += [int(ids[i])] * len(near)
                right += ids[near].tolist()
        return left, right

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            left: list[int] = []
            right: list[int] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("sig", "cid", "comp", "n", "sketch"))):
                if held and held[0][0] != row[0]:
                    a, b = pairs(held)
                    left += a
                    right += b
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])
        if held:
            a, b = pairs(held)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


_COMPARED = "a long, b long, linked boolean, na long, nb long, d long, differ array<long>"
_COMPARED_SCHEMA = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("linked", pa.bool_()), ("na", pa.int64()), ("nb", pa.int64()), ("d", pa.int64()), ("differ", pa.list_(pa.int64()))])


def _verifier(n: int, p: int, q: int, common: np.ndarray):
    """Compares words. Pairs that are not linked are returned only where ``a`` is the pivot of a large group, with the differences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[tuple[int, str], set] = {}
        hashes: dict[tuple[int, str], np.ndarray] = {}

        def of(known: dict, i: int, text: str | None, make) -> set | np.ndarray:
            found = known.get((i, text))
            if found is None:
                if len(known) >= 32:
                    known.clear()
                found = known[(i, text)] = make(text or "")
            return found

        for whole in batches:
            for batch in text_parts(whole, "text_b", BATCH_BYTES):
                rows = []
                sets = iter(shingle_sets(batch.filter(batch.column("big")).column("text_b"), n))
                for a, b, big, s, t in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "big", "text_a", "text_b"))):
                    is_linked = similar(of(words, a, s, lambda x: exact_shingles(x, n)), exact_shingles(t or "", n), p, q)
                    if big:
                        own, pivot = next(sets), of(hashes, a, s, lambda x: shingle_sets(pa.array([x]), n)[0])
                        found = differences(own, pivot, common)
                        rows.append((a, b, is_linked, len(pivot), len(own), len(found), _signed(found)))
                    elif is_linked:
                        rows.append((a, b, True, None, None, None, None))
                cols = list(zip(*rows)) or [()] * len(_COMPARED_SCHEMA)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, _COMPARED_SCHEMA)], schema=_COMPARED_SCHEMA)

    return run


def _few(*tables: DataFrame) -> bool:
    return all(t.limit(FEW_LINKS + 1).count() <= FEW_LINKS for t in tables)


def _gathered(table: DataFrame, few: bool) -> DataFrame:
    """A table of few rows in one partition: joins and sums over such need no exchange."""
    return table.coalesce(1) if few else table


def components(edges: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable. Labels spread to neighbours, then jump to their label's label.

    Up to ``FEW_LINKS`` links take the same steps in one task: a bound that does
    not grow, where a round would else cost many tasks that are almost empty.
    """
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).where("node <> other").distinct()
    links = materialise(both, "links")
    few = _few(links)
    both = _gathered(links, few)
    step = materialise(both.groupBy("node").agg(F.least(F.col("node"), F.min("other")).alias("comp")), "labels")
    while True:
        before, labels = step, _gathered(step, few).select("node", "comp")
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("comp").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        jump = labels.select(F.col("node").alias("new"), F.col("comp").alias("far"))
        step = materialise(step.join(jump, "new", "left").select("node", F.least("new", "far").alias("comp"), "old"), "labels")
        discard(before)
        if step.where("comp <> old").isEmpty():
            discard(links)
            return step.select("node", "comp")


class _Join:
    """The tables of one join, and the comparison of pairs."""

    def __init__(self, docs: DataFrame, n: int, p: int, q: int, key_bits: int):
        self.spark, self.docs, self.n, self.p, self.q = docs.sparkSession, docs, n, p, q
        self.every = materialise(docs.mapInArrow(_measure(n, key_bits), _LIGHT), "shingle-sets")
        self.sets = self.every.where("kind = 0 and n_shingles > 0")
        by_size = self.sets.groupBy(F.floor(4 * F.log2("n_shingles")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.max("n_shingles").alias("m"), F.sum("n_shingles").alias("s")).collect()
        total = sum(r["c"] for r in by_size)
        # At most (mean set size) / COMMON shingles can be so common: a bound that does not grow with the corpus.
        often = self.every.where("kind = 1").groupBy("k1").agg(F.sum("n_shingles").alias("c")).where(F.col("c") >= max(4, COMMON * total))
        self.common = np.sort(np.array([r["k1"] for r in often.select("k1").toLocalIterator()], dtype=np.int64).view(np.uint64))
        met, could = self.every.where("kind = 2").agg(F.sum("n_shingles"), F.sum(F.col("k1").cast("double"))).first()
        shared = min(0.5, max(1e-9, (met or 0) / (could or 1)))
        self.bands = plan_bands(max((r["m"] for r in by_size), default=0), {r["b"]: r["c"] for r in by_size}, p, q, shared)
        rows = sum(r["s"] for r in by_size) * (q - p) / (q + p) * 2.8
        self.buckets = max(partitions(self.spark), math.ceil(rows * 17 / BUCKET_BYTES))
        self.key_bits = key_bits

    def nodes(self) -> DataFrame:
        """k1, k2, words, node, n: the node of each set, which is the smallest id of its class. Equal sets of other words are compared."""
        words = self.sets.groupBy("k1", "k2", "words").agg(F.min("doc_id").alias("cid"), F.max("n_shingles").alias("n")).where("cid is not null")
        words = materialise(words, "shingle-words")
        roots = words.groupBy("k1", "k2").agg(F.min("cid").alias("root"), F.count(F.lit(1)).alias("kinds"))
        rooted = words.join(roots, ["k1", "k2"])
        doubtful = rooted.where("kinds > 1 and cid <> root").select(F.col("root").alias("a"), F.col("cid").alias("b")).distinct()
        doubtful = materialise(doubtful.withColumn("big", F.lit(False)), "equal-sets")
        if doubtful.isEmpty():
            return rooted.select("k1", "k2", "words", F.col("root").alias("node"), "n")
        ids = doubtful.select(F.col("a").alias("cid")).union(doubtful.select("b")).distinct()
        texts = self.docs.select(F.col("doc_id").alias("cid"), "text").join(ids, "cid", "left_semi")
        same = materialise(self.with_texts(doubtful, texts).mapInArrow(_verifier(self.n, 1, 1, self.common), _COMPARED).select(F.col("b").alias("cid"), F.lit(True).alias("same")).distinct(), "equal-sets")
        return rooted.join(same, "cid", "left").select("k1", "k2", "words", F.when((F.col("cid") == F.col("root")) | F.col("same"), F.col("root")).otherwise(F.col("cid")).alias("node"), "n")

    @staticmethod
    def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
        """Both texts of written pairs. Pivots are few: only their texts are dealt by ``a``, and where the pairs are broadcast no text is dealt by ``b``."""
        pivots = materialise(pairs.select("a").distinct(), "pivot-ids")
        first = texts.join(pivots.withColumnRenamed("a", "cid"), "cid", "left_semi").select(F.col("cid").alias("a"), F.col("text").alias("text_a"))
        two = pairs.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("text_b")), "b")
        return two.join(first, "a").select("a", "b", "big", "text_a", "text_b")

    def met(self, entries: DataFrame) -> DataFrame:
        return entries.groupBy("bucket").applyInArrow(lambda t: _meet(t.drop_columns(["bucket"])), "sig long, k1 long")

    def groups(self, nodes: DataFrame) -> DataFrame:
        entries = self.docs.mapInArrow(_enter(self.n, self.bands, self.common, self.p, self.q, self.buckets, self.key_bits), _ENTRIES)
        return self.met(entries).join(nodes.groupBy("k1", "node").agg(F.max("n").alias("n")), "k1").select("sig", F.col("node").alias("cid"), "n").distinct()

    def members(self, groups: DataFrame) -> None:
        """Sketches of all that met. Their texts are read where pairs are compared, from the documents themselves."""
        ids = groups.select("cid").distinct()
        self.texts = self.docs.select(F.col("doc_id").alias("cid"), "text")
        self.sketches = materialise(self.sets.select(F.col("doc_id").alias("cid"), F.col("n_shingles").alias("n"), "sketch").join(ids, "cid", "left_semi"), "met-sketches")

    def rest(self, groups: DataFrame) -> DataFrame:
        """What may be similar among the members of bounded groups (sig, cid, comp) in different components."""
        rows = groups.join(self.sketches, "cid").select("sig", "cid", "comp", "n", "sketch").repartition("sig").sortWithinPartitions("sig")
        return rows.mapInArrow(_plausible_in_groups(self.p, self.q), "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def compared(self, pairs: DataFrame, plausible: DataFrame) -> DataFrame:
        """``pairs``: a, b, big; ``plausible``: a, b. Linked ones, and all big ones with their differences."""
        small = pairs.where("not big")
        for side in ("b", "a"):
            small = small.join(self.sketches.select(F.col("cid").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
        fit = small.where((self.q * F.col("na") >= self.p * F.col("nb")) & (self.q * F.col("nb") >= self.p * F.col("na")))
        fit = fit.select("a", "b", "na", "nb", "sketch_a", "sketch_b").mapInArrow(_plausible(self.p, self.q), "a long, b long").union(plausible).distinct()
        chosen = materialise(fit.withColumn("big", F.lit(False)).union(pairs.where("big").select("a", "b", "big")), "chosen")
        return materialise(self.with_texts(chosen, self.texts).mapInArrow(_verifier(self.n, self.p, self.q, self.common), _COMPARED), "compared")


def _open(groups: DataFrame, comp: DataFrame) -> DataFrame:
    """Groups with their members' components, where these are several."""
    named = groups.join(comp.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    several = named.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("sig")
    return named.join(several, "sig")


def linked(docs: DataFrame, n: int, p: int, q: int, key_bits: int = 64) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(light rows: doc_id, n_shingles, k1, k2, words; nodes: k1, k2, words, node; components of nodes: node, comp).

    ``docs`` has doc_id (long) and text. ``key_bits`` below 64 makes sets share keys, for tests.
    """
    join = _Join(docs, n, p, q, key_bits)
    spark = join.spark
    nodes = materialise(join.nodes(), "nodes")
    groups = materialise(join.groups(nodes), "met")
    join.members(groups)
    comp = spark.createDataFrame([], "node long, comp long")
    rest, level = spark.createDataFrame([], "a long, b long"), 0  # what small groups of the level before have left to compare
    while True:
        # The member of many large groups is most like the others: the text that the rest are copies of.
        own = _gathered(groups, _few(groups))
        sized = own.join(own.groupBy("sig").agg(F.count(F.lit(1)).alias("size")), "sig")
        weights = sized.groupBy("cid").agg(F.sum("size").alias("weight"))
        small = SMALL * ANEW if level else SMALL
        best = sized.join(weights, "cid").groupBy("sig").agg(F.max(F.struct("weight", "cid")).alias("own"), (F.first("size") > small).alias("big"))
        # A large group takes the heaviest pivot that one of its members has in any large group, be it a member or not.
        large = sized.where(F.col("size") > small).select("sig", "cid")
        top = large.join(best, "sig").groupBy("cid").agg(F.max("own").alias("top"))
        shared = large.join(top, "cid").groupBy("sig").agg(F.max("top").alias("top"))
        best = best.join(shared, "sig", "left").select("sig", "big", F.coalesce("top", "own")["cid"].alias("a"))
        sized = materialise(sized.join(best, "sig").where("cid <> a").select("sig", "a", F.col("cid").alias("b"), "big"), "pivots")
        result = join.compared(sized.groupBy("a", "b").agg(F.max("big").alias("big")), rest)
        before, comp = comp, _joined_components(comp, result.where("linked"))
        spent = [groups, sized, result, rest, before]
        rest = materialise(join.rest(_open(sized.where("not big").select("sig", F.col("b").alias("cid")), comp)), "rest")
        # A family: a pivot and the members of a large group, or of all that have that pivot on the first level.
        family = sized.where("big").select(F.col("sig" if level else "a").alias("family"), "a", "b").distinct()
        labels = comp.withColumnRenamed("comp", "label")
        inner = family.join(labels.select(F.col("node").alias("a"), F.col("label").alias("ca")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("cb")), "b", "left")
        still = inner.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("family").distinct()
        families = materialise(family.join(still, "family", "left_semi").join(result.where("differ is not null"), ["a", "b"]), "families")
        entered = families.agg(F.sum("d")).first()[0]
        if entered is None and rest.isEmpty():
            discard(*spent, families, rest)
            break
        often = families.select("family", "differ").mapInArrow(_often_in_chunk(FREQUENT), _OFTEN)
        for keys, least in ((["family", "salt"], 0), (["family"], SMALL)):
            often = often.groupBy(*keys).applyInArrow(_often_in_all(FREQUENT if least else FREQUENT / 2, least), _OFTEN)
        often = often.select("family", F.col("xs").alias("frequent"))
        buckets = max(partitions(spark), math.ceil((entered or 0) * 4 * 17 / BUCKET_BYTES))
        entries = families.join(often, "family", "left").select("family", "b", "na", "nb", "d", "linked", "differ", "frequent").mapInArrow(_enter_differences(p, q, buckets), _ENTRIES)
        met = materialise(join.met(entries).select("sig", F.col("k1").alias("cid")).distinct(), "met")
        few = _few(met, comp)
        groups = materialise(_open(_gathered(met, few), _gathered(comp, few)).select("sig", "cid"), "met")
        discard(*spent, families, met)
        level += 1
    discard(join.sketches)
    return join.every.where("kind = 0"), nodes, comp


def _joined_components(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """The components after more links: only their labels are joined, the nodes are renamed."""
    if edges.isEmpty():
        return materialise(comp, "components")
    few = _few(edges, comp)
    edges, comp = _gathered(edges.select("a", "b"), few), _gathered(comp, few)
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    every = comp.join(_gathered(nodes, few), "node", "full_outer").select("node", F.coalesce("comp", "node").alias("comp"))
    written = materialise(every, "components")
    every = _gathered(written, few)
    ends = edges.join(every.select(F.col("node").alias("a"), F.col("comp").alias("x")), "a").join(every.select(F.col("node").alias("b"), F.col("comp").alias("y")), "b")
    renamed = _gathered(components(ends.select(F.col("x").alias("a"), F.col("y").alias("b"))), few).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    out = materialise(every.join(renamed, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "components")
    discard(written)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, p: int = 80, q: int = 100, key_bits: int = 64) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    Rows link when q * intersection >= p * union. Texts without words (null and
    empty ones) have no shingles and are their own component; shorter ones than
    ``n`` words have their whole sequence as one shingle. Rows that repeat an id
    are one node. Rows with a null id link nothing and have a null component. An
    empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    light, nodes, comp = linked(rows, n, p, q, key_bits)
    full = light.where("n_shingles > 0").select("doc_id", "n_shingles", "k1", "k2", "words")
    classes = materialise(nodes.join(comp, "node", "left").select("k1", "k2", "words", F.coalesce("comp", "node").alias("component_id")), "classes")
    found = full.where("doc_id is not null").join(classes, ["k1", "k2", "words"]).select("doc_id", "n_shingles", "component_id")
    found = found.union(full.where("doc_id is null").select("doc_id", "n_shingles", F.lit(None).cast("long")))
    return found.union(light.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, p: int = 80, q: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, with all their columns; null ids stay."""
    found = jaccard_components(docs, id_col, text_col, n, p, q)
    gone = materialise(found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")), "near-copies")
    renamed = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in renamed.items()])
    kept = rows.join(gone, F.col(renamed[id_col]) == F.col("_gone"), "left_anti")
    return kept.select(*[F.col(x).alias(c) for c, x in renamed.items()])
