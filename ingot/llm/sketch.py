"""Shingle sets and Fast Similarity Sketches of texts, in numpy on Arrow batches.

A sketch has T coordinates. In round i every shingle is hashed to a bin and a
value i + fraction, and a bin keeps its smallest value; after T rounds, round
T + j throws all shingles into bin j, so every coordinate is filled after at most 2 T rounds, and
a set of a few hundred shingles is done after one or two. Two sets agree in a
coordinate with a probability of their Jaccard similarity, concentrated as
for T independent hashes (Dahlgaard, Knudsen and Thorup, 2017).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from ingot.llm.common import ships

ships(__name__)

T = 128
ROWS = 4  # coordinates in a band: 32 bands miss a pair of similarity 0.8 once in 2e7
BANDS = T // ROWS
EMPTY = np.uint64(2**64 - 1)
PAIRS = 1 << 18  # pairs that are sorted at once, about

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, 2 * T + BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit shingles of ``size`` words; fewer words make one shingle, none an empty set.

    Only A-Z is lowered, and only space and \\t \\n \\v \\f \\r separate words, as bytes.split() does.
    """
    if not text:
        return np.empty(0, np.uint64)
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(h) < size:
        size = len(h)
    n = len(h) - size + 1
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n])
    return np.unique(out)


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """One row of T values for each non-empty set: the round in the upper 8 bits, 56 bits of hash below."""
    n = len(sets)
    out = np.full((n, T), EMPTY, np.uint64)
    flat = out.reshape(-1)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets) if n else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(n), sizes)
    left = np.ones(n, bool)
    for i in range(2 * T):
        mine = left[owner]
        if not mine.all():
            values, owner = values[mine], owner[mine]
        if not len(values):
            break
        h = _mix(values ^ _SEEDS[i])
        v = (np.uint64(i) << np.uint64(56)) | (h >> np.uint64(8))
        if i < T:
            np.minimum.at(flat, owner * T + (h & np.uint64(T - 1)).astype(np.int64), v)
        else:
            np.minimum.at(flat, owner * T + (i - T), v)  # later rounds never lower a filled bin
        left = (out == EMPTY).any(axis=1)
    return out


def band_keys(sk: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, the same for two sets that agree in all of its coordinates."""
    key = np.broadcast_to(_SEEDS[2 * T : 2 * T + BANDS], (len(sk), BANDS)).copy()
    for k in range(ROWS):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + sk.reshape(len(sk), BANDS, ROWS)[:, :, k])
    return key.view(np.int64)


def sketch_batches(size: int):
    """For mapInArrow over (doc_id, text, tx): doc_id, tx, set_id, n, bands, brief (8 bits of each coordinate)."""

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(1)]
            full = [s for s in sets if len(s)]
            sk = sketches(full)
            keys, brief = iter(band_keys(sk).tolist()), iter((sk & np.uint64(255)).astype(np.uint8))
            rows = [(xxhash.xxh3_128_digest(s.tobytes()), len(s), next(keys), next(brief).tobytes()) if len(s) else (None, 0, None, None) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([r[0] for r in rows], pa.binary()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.list_(pa.int64())),
                    pa.array([r[3] for r in rows], pa.binary()),
                ],
                names=["doc_id", "tx", "set_id", "n", "bands", "brief"],
            )

    return run


def set_batches(size: int):
    """For mapInArrow over (set_id, text): set_id, shingles (8 bytes each, sorted)."""

    def run(batches):
        for b in batches:
            sets = [shingles(t.as_py(), size).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["set_id", "shingles"])

    return run


def near_batches(least: int, percent: int):
    """For mapInArrow over (a, b, n_a, n_b, brief_a, brief_b): a, b, agree where sizes and sketches allow a link."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, T) for k in (4, 5))
            agree = (x == y).sum(axis=1)
            n, m = np.asarray(b.column(2)), np.asarray(b.column(3))
            good = (agree >= least) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
            out = pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(agree, pa.int32())], names=["a", "b", "agree"])
            yield out.filter(pa.array(good))

    return run


def _rows_by_group(table: pa.Table):
    """group -> row numbers"""
    out = {}
    for i, y in enumerate(table.column("y").to_pylist()):
        out.setdefault(y, []).append(i)
    return out


def _briefs(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("brief").to_pylist()), np.uint8).reshape(-1, T)


def _agreeing(outside: pa.Table, inside: pa.Table, least: int):
    """Row numbers (i, j array, agreement array) of the pairs of each group whose sketches agree often enough."""
    x, y = _briefs(outside), _briefs(inside)
    mine = _rows_by_group(inside)
    for group, rows in _rows_by_group(outside).items():
        there = np.array(mine.get(group, []), int)
        if not len(there):
            continue
        held = y[there]
        for i in rows:
            agree = (held == x[i]).sum(axis=1)
            hit = agree >= least
            if hit.any():
                yield i, there[hit], agree[hit]


def _nearest_first(outside: pa.Table, inside: pa.Table, least: int):
    """Pairs (i, j) of ``_agreeing``, in batches of some PAIRS, of each batch the nearest first."""
    held, n = [], 0

    def ordered():
        i, j, agree = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.argsort(-agree, kind="stable")
        return zip(i[at].tolist(), j[at].tolist(), strict=True)

    for i, js, agree in _agreeing(outside, inside, least):
        held.append((np.full(len(js), i), js, agree))
        n += len(js)
        if n >= PAIRS:
            yield from ordered()
            held, n = [], 0
    if held:
        yield from ordered()


def close_nodes(least: int, percent: int):
    """For cogroup.applyInArrow of a cell's outside and all nodes (a, y, own, n, brief): a, y, own of those with a near other."""
    schema = pa.schema([("a", pa.binary()), ("y", pa.binary()), ("own", pa.bool_())])

    def run(outside: pa.Table, inside: pa.Table) -> pa.Table:
        if not outside.num_rows or not inside.num_rows:
            return schema.empty_table()
        n, m = np.asarray(outside.column("n")), np.asarray(inside.column("n"))
        names, others = outside.column("a").to_pylist(), inside.column("a").to_pylist()
        first, second = set(), set()
        for i, js, _ in _agreeing(outside, inside, least):
            js = js[100 * np.minimum(n[i], m[js]) >= percent * np.maximum(n[i], m[js])]
            js = [j for j in js if others[j] != names[i]]
            if js:
                first.add(i)
                second.update(js)
        out = [t.take(pa.array(sorted(k), pa.int64())).select(["a", "y", "own"]) for t, k in ((outside, first), (inside, second))]
        return pa.concat_tables([x.cast(schema) for x in out])

    return run


def group_links(least: int, percent: int):
    """For cogroup.applyInArrow of a cell's outside and all nodes (a, y, own, brief, shingles): links (a, b) that join its components.

    The nearest pairs of a batch are tested first; a pair that earlier links have joined isn't tested.
    """
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def run(outside: pa.Table, inside: pa.Table) -> pa.Table:
        if not outside.num_rows or not inside.num_rows:
            return schema.empty_table()
        names, others = outside.column("a").to_pylist(), inside.column("a").to_pylist()
        groups, own = inside.column("y").to_pylist(), inside.column("own").to_pylist()
        # the nodes of a group's component are connected already, by links found before
        root = {}

        def find(x):
            while (up := root.get(x, x)) != x:
                root[x] = x = root.get(up, up)
            return x

        for name, y, mine in zip(others, groups, own, strict=True):
            if mine:
                root[find(name)] = find(("component", y))
        held, found = {}, []

        def shingles_of(table, k, name):
            if name not in held:
                held[name] = np.frombuffer(table.column("shingles")[k].as_buffer(), np.uint64)
            return held[name]

        for i, j in _nearest_first(outside, inside, least):
            a, b = names[i], others[j]
            if find(a) == find(b):
                continue
            x, y = shingles_of(outside, i, a), shingles_of(inside, j, b)
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            small, large = (x, y) if len(x) <= len(y) else (y, x)
            at = np.searchsorted(large, small)
            shared = int((large[np.minimum(at, len(large) - 1)] == small).sum())
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                root[find(a)] = find(b)
                found.append((a, b))
        return pa.Table.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], schema=schema)

    return run


def link_batches(percent: int):
    """For mapInArrow over (a, b, set_a, set_b): the pairs whose sets share ``percent`` of their union or more."""

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

    return run
