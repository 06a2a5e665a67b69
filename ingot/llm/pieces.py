"""Operator 4: SentencePiece encoding and decoding on a relational lattice.

1. A text is cut into segments that no piece of the model can cross: a word with its marks, cut between every two
   characters that are never neighbours inside a piece. The segments of the words that are frequent in a task are counted, and the
   most frequent ones, of HEAD bytes with their ids at most, make the dictionary. What is in it changes no result.
2. Lattice: every segment is exploded into its substrings of bounded length,
   these are equi-joined with the piece table (bounded by the model, so it is broadcast), and the
   matches are grouped by segment as edges.
3. Each segment's edges are folded with higher-order ``aggregate``: for a unigram model to the
   best path by summed scores (Viterbi), for a model whose type is BPE to what its merges, in order of score, leave.
   A BPE model's encoding is defined by its merges, and the best path by its scores is another one for many
   words, so Viterbi would not give the right ids there. The fold takes the square of a segment's length, so a
   segment of more than LONG characters (a run without any cut) is encoded by a queue of merges, or by a plain
   best path, in the task that holds it.
4. The dictionary goes to the tasks. The lattice of all other segments is built and folded where the text is, of many segments at
   once: the same substrings are joined to the same piece table and folded in the same order, as arrays. No text is shuffled, and
   what a task holds doesn't grow with the input.

Decoding looks the ids' bytes up in an array and reads them as UTF-8.

As in SentencePiece, a space and U+2581 are the same mark, a mark is put before the text, and
characters without a piece become byte pieces. Edge cases: a null or empty text has no pieces and
decodes to the empty text; a text of spaces only is one run of marks; repeated rows give equal rows; an
empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ingot.llm.common import let, materialise, prepare, ships, text_of

ships(__name__)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
HEAD = 8 << 20  # bytes of the tasks' dictionary, at most
ENTRY = 24  # bytes of an entry besides its ids: a digest and an end
CACHE = 200_000  # words whose ids a task remembers, at most, twice over; and segments
OFTEN = 8  # times that a word stands in what a task counts at once, for its segments to be counted
LONG = 256  # characters of a segment that is folded in the lattice, at most
GROUP = 1 << 18  # characters of the texts whose words are looked up at once, about
PER_TASK = 20_000  # segments of a lattice partition, about
PLACES = 18  # bits of the places of the pieces' hashes
UNKNOWN_PENALTY = 10.0  # fixed value: below the lowest score, as in SentencePiece

MARKED_WORD = re.compile(f"{MARK}+[^{MARK}]*")


@dataclass
class Model:
    pieces: list[tuple[str, int, float]]  # those a text can match: piece, id, score
    bytes_from: int  # the id of byte 0
    hexes: list[str]  # by id: the bytes of a piece, in hexadecimal
    unknown: float  # the score of a character without a piece
    longest: int
    merges: bool  # BPE

    @classmethod
    def load(cls, path: str = MODEL) -> Model:
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only models that keep the text and put a mark before it are supported")
        every = list(enumerate(proto.pieces))
        pieces = [(p.piece, i, p.score) for i, p in every if p.type in (kinds.NORMAL, kinds.USER_DEFINED)]
        if any(MARK in p.lstrip(MARK) for p, _, _ in pieces):
            raise ValueError("pieces cross the words' borders")
        first = next((i for i, p in every if p.type == kinds.BYTE), 0)
        if [p.piece for p in proto.pieces[first : first + 256]] != [f"<0x{b:02X}>" for b in range(256)]:
            raise ValueError("the model has no row of byte pieces")
        surface = {kinds.BYTE: lambda p: p.piece[3:5], kinds.NORMAL: lambda p: p.piece.encode().hex()}
        surface[kinds.USER_DEFINED] = surface[kinds.NORMAL]
        hexes = [surface[p.type](p) if p.type in surface else "" for _, p in every]
        lowest = min(p.score for _, p in every if p.type == kinds.NORMAL)
        merges = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        return cls(pieces, first, hexes, lowest - UNKNOWN_PENALTY, max(len(p) for p, _, _ in pieces), merges)

    @property
    def pairs(self) -> np.ndarray:
        """The pairs of characters that are neighbours inside a piece, as sorted numbers."""
        return np.array(sorted({ord(a) << 21 | ord(b) for p, _, _ in self.pieces for a, b in zip(p, p[1:])}), np.uint64)


def words_of(text: str) -> list[str]:
    """The marked words of a text, without the one mark that each begins with; joined by marks they give the text."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return text.split(" ")
    return [w[1:] for w in MARKED_WORD.findall(MARK + text.replace(" ", MARK))]


def segments_of(words: list[str], pairs: np.ndarray) -> tuple[list[str], list[int]]:
    """The words, each with a mark before it, cut between all neighbours that no piece has; and where each word's segments begin, and the end."""
    if not words:
        return [], [0]
    joined = MARK + MARK.join(words)
    chars = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.uint64)
    near = chars[:-1] << np.uint64(21) | chars[1:]
    cut = np.ones(len(chars), bool)
    if len(pairs):
        cut[1:] = pairs[np.minimum(pairs.searchsorted(near), len(pairs) - 1)] != near
    starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
    cut[starts] = True
    at = np.flatnonzero(cut)
    ends = [*at[1:].tolist(), len(joined)]
    return [joined[x:y] for x, y in zip(at.tolist(), ends, strict=True)], [*at.searchsorted(starts).tolist(), len(at)]


def count_batches(pairs: np.ndarray):
    """For mapInArrow over (text): seg, n: the segments of frequent words with their counts so far."""

    def flush(seen):
        often = {w: n for w, n in seen.items() if n >= OFTEN}
        segs, firsts = segments_of(list(often), pairs)
        total = Counter()
        for s, n in zip(segs, np.repeat(list(often.values()), np.diff(firsts)).tolist(), strict=True):
            total[s] += n
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["seg", "n"])

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0):
                seen.update(words_of(t.as_py()))
                if len(seen) > 2 * CACHE:
                    yield flush(seen)
                    seen = Counter()
        yield flush(seen)

    return run


# --------------------------------------------------------------------------- the lattice

def edges(segments: DataFrame, model: Model, ranked: bool = False) -> DataFrame:
    """Per segment (seg, n): edges (e, s, score, id), by end and start; id -1 stands for a character without a piece.

    ``ranked``: (rank, s, e, id) instead, the single characters from the left, then the others by falling score and start.
    """
    rows = segments.sparkSession.createDataFrame(model.pieces, "piece string, id int, score double")
    n = F.length("seg")
    starts = segments.select("seg", "n", F.explode(F.sequence(F.lit(0), n - 1)).alias("s"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(model.longest), n - F.col("s")))
    parts = starts.select("seg", "n", "s", F.explode(sizes).alias("k"))
    parts = parts.select("seg", "n", "s", (F.col("s") + F.col("k")).alias("e"), F.substr(F.col("seg"), F.col("s") + 1, F.col("k")).alias("piece"))
    found = parts.join(F.broadcast(rows), "piece", "left").filter("id is not null or e - s = 1")
    score, at = F.coalesce("score", F.lit(model.unknown)).alias("score"), F.coalesce("id", F.lit(-1)).alias("id")
    edge = F.struct("e", "s", score, at)
    if ranked:
        edge = F.struct(F.when(F.col("e") - F.col("s") > 1, -score).alias("rank"), "s", "e", at)  # nulls come first
    return found.groupBy("seg", "n").agg(F.sort_array(F.collect_list(edge)).alias("edges"))


def best_path(edges: Column) -> Column:
    """Viterbi: the pieces (s, e, id) of the path with the greatest sum of scores; of equals the longer last piece."""
    node = "struct<score:double,s:int,id:int>"
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("s"), F.lit(-1).alias("id"))).cast(f"array<{node}>")
    zero = F.struct(start.alias("done"), F.lit(1).alias("e"), F.lit(None).cast(node).alias("best"))
    zero = zero.cast(f"struct<done:array<{node}>,e:int,best:{node}>")

    def step(acc: Column, x: Column) -> Column:
        # edges come by end: with a new end, the best one of the last end is settled
        done = F.when(x["e"] == acc["e"], acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["best"])))
        held = F.when(x["e"] == acc["e"], acc["best"])

        def choose(d: Column) -> Column:
            score = F.get(d, x["s"])["score"] + x["score"]
            mine = F.struct(score.alias("score"), x["s"].alias("s"), x["id"].alias("id"))
            best = F.when(held.isNull() | (score > held["score"]), mine).otherwise(held)
            return F.struct(d.alias("done"), x["e"].alias("e"), best.alias("best"))

        return let(done, choose)

    def back(nodes: Column) -> Column:
        empty = F.struct((F.size(nodes) - 1).alias("at"), F.array().cast("array<struct<s:int,e:int,id:int>>").alias("out"))
        empty = empty.cast("struct<at:int,out:array<struct<s:int,e:int,id:int>>>")

        def pace(acc: Column, _: Column) -> Column:
            node_at = F.get(nodes, acc["at"])
            piece = F.struct(node_at["s"].alias("s"), acc["at"].alias("e"), node_at["id"].alias("id"))
            more = F.struct(node_at["s"].alias("at"), F.concat(acc["out"], F.array(piece)).alias("out"))
            return F.when(acc["at"] > 0, more).otherwise(acc)

        return F.reverse(F.aggregate(nodes, empty, pace)["out"])

    end = F.aggregate(edges, zero, step)
    return let(let(end, lambda a: F.concat(a["done"], F.array(a["best"]))), back)


def merged_path(edges: Column, length: Column) -> Column:
    """BPE: the pieces (s, e, id) of a segment of ``length`` characters after all merges, the highest score and then the leftmost first.

    ``edges`` are ranked. A piece outranks every piece that contains it, so one pass in that order makes the merges in theirs.
    """
    symbol = "array<struct<e:int,id:int>>"
    state = F.transform(F.slice(edges, F.lit(1), length), lambda x: F.struct(x["e"].alias("e"), x["id"].alias("id"))).cast(symbol)
    ranked = F.slice(edges, length + 1, F.size(edges))
    gone = F.struct(F.lit(-1).alias("e"), F.lit(-1).alias("id"))

    def step(acc: Column, x: Column) -> Column:
        middle = F.get(acc, x["s"])["e"]
        fits = (middle > 0) & (middle < x["e"]) & (F.get(acc, middle)["e"] == x["e"])
        joined = F.struct(x["e"].alias("e"), x["id"].alias("id"))
        new = F.transform(acc, lambda y, i: F.when(i == x["s"], joined).when(i == middle, gone).otherwise(y))
        return F.when(fits, new).otherwise(acc)

    def path(symbols: Column) -> Column:
        parts = F.transform(symbols, lambda y, i: F.struct(i.alias("s"), y["e"].alias("e"), y["id"].alias("id")))
        return F.filter(parts, lambda y: y["e"] > 0)

    return let(F.aggregate(ranked, state, step), path)


def ids_of(path: Column, seg: Column, model: Model) -> Column:
    def bytes_at(s: Column) -> Column:
        code = F.hex(F.encode(F.substr(seg, s + 1, F.lit(1)), "UTF-8"))
        return F.transform(
            F.sequence(F.lit(0), F.shiftright(F.length(code), 1) - 1),
            lambda k: F.conv(F.substr(code, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + model.bytes_from,
        )

    return F.flatten(F.transform(path, lambda x: F.when(x["id"] >= 0, F.array(x["id"])).otherwise(bytes_at(x["s"]))))


def queued(seg: str, table: dict[str, tuple[int, float]], model: Model) -> list[tuple[int, int]]:
    """BPE of a long segment: starts and ends of what a queue of merges, by score and start, leaves."""
    after, before = list(range(1, len(seg) + 1)), list(range(-1, len(seg) - 1))

    def merge(s: int, m: int):
        if 0 <= s and m < len(seg):
            e = after[m]
            hit = table.get(seg[s:e]) if e - s <= model.longest else None
            if hit:
                return -hit[1], s, m, e
        return None

    queue = [x for x in (merge(s, s + 1) for s in range(len(seg) - 1)) if x]
    heapify(queue)
    while queue:
        _, s, m, e = heappop(queue)
        if after[s] != m or after[m] != e:
            continue  # one of the two is another symbol by now
        after[s], after[m] = e, -1
        if e < len(seg):
            before[e] = s
        for x in (merge(before[s], s), merge(s, e)):
            if x:
                heappush(queue, x)
    out, s = [], 0
    while s < len(seg):
        out.append((s, after[s]))
        s = after[s]
    return out


def scored(seg: str, table: dict[str, tuple[int, float]], model: Model) -> list[tuple[int, int]]:
    """Viterbi over a long segment: starts and ends of its best path; of equals the longer last piece."""
    best, back = [0.0] + [float("-inf")] * len(seg), [0] * (len(seg) + 1)
    for e in range(1, len(seg) + 1):
        for s in range(max(0, e - model.longest), e):
            score = table.get(seg[s:e], (-1, model.unknown) if e - s == 1 else None)
            if score and best[s] + score[1] > best[e]:
                best[e], back[e] = best[s] + score[1], s
    out, e = [], len(seg)
    while e:
        out.append((back[e], e))
        e = back[e]
    return out[::-1]


def ids_along(seg: str, table: dict[str, tuple[int, float]], model: Model) -> list[int]:
    """The ids of a segment by a queue of merges, or by its best path."""
    path = queued if model.merges else scored
    found = ((seg[s:e], table.get(seg[s:e])) for s, e in path(seg, table, model))
    return [x for p, hit in found for x in ([hit[0]] if hit else [model.bytes_from + c for c in p.encode()])]


def long_batches(model: Model):
    """For mapInArrow over (seg, n): seg, n, ids: segments that are too long to fold."""

    def run(batches):
        table = {p: (i, score) for p, i, score in model.pieces}
        for b in batches:
            ids = [ids_along(seg, table, model) for seg in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["seg", "n", "ids"])

    return run


def segment_table(segments: DataFrame, model: Model) -> DataFrame:
    """Per segment (seg, n): ids, by the model's rule."""
    spark = segments.sparkSession
    spark.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(2 * PER_TASK))
    long = F.length("seg") > LONG
    parts = segments.count() // PER_TASK + 1
    lattice = edges(segments.filter(~long).repartition(parts, "seg"), model, model.merges)
    path = merged_path(F.col("edges"), F.length("seg")) if model.merges else best_path(F.col("edges"))
    folded = lattice.withColumn("path", path).select("seg", "n", ids_of(F.col("path"), F.col("seg"), model).alias("ids"))
    return folded.union(segments.filter(long).select("seg", "n").mapInArrow(long_batches(model), "seg string, n long, ids array<int>"))


# --------------------------------------------------------------------------- the lattice of a task's segments


def _hash(before: np.ndarray, chars: np.ndarray) -> np.ndarray:
    return before * np.uint64(0x9E3779B97F4A7C15) + chars + np.uint64(1)


def _place(h: np.ndarray) -> np.ndarray:
    return h * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PLACES)


def piece_table(model: Model) -> dict[int, tuple]:
    """By length: which places hold a piece's hash, the pieces' hashes, sorted, their characters, ids and ranks (0: the highest score)."""
    rank = np.unique([-score for _, _, score in model.pieces], return_inverse=True)[1] if model.pieces else []
    out = {}
    for k in sorted({len(p) for p, _, _ in model.pieces}):
        rows = [(p, i, r) for (p, i, _), r in zip(model.pieces, rank, strict=True) if len(p) == k]
        chars = np.frombuffer("".join(p for p, _, _ in rows).encode("utf-32-le"), np.uint32).reshape(-1, k)
        h = np.zeros(len(rows), np.uint64)
        for j in range(k):
            h = _hash(h, chars[:, j])
        if len(np.unique(h)) < len(h):
            raise ValueError("two pieces have one hash")
        at, held = np.argsort(h), np.zeros(1 << PLACES, bool)
        held[_place(h)] = True
        out[k] = (held, h[at], chars[at], np.array([i for _, i, _ in rows])[at], np.array([r for _, _, r in rows])[at])
    return out


def folded(segs: list[str], table: dict[int, tuple], bytes_from: int) -> list[bytes]:
    """The ids (4 bytes each) that the merges leave of each of these segments, as :func:`edges`, :func:`merged_path` and :func:`ids_of` do.

    The k-th edges of all segments are folded together: an edge joins two symbols if they are what it spans.
    """
    if not segs:
        return []
    size = np.fromiter(map(len, segs), np.int64, len(segs))
    chars = np.frombuffer("".join(segs).encode("utf-32-le"), np.uint32)
    own, stop = np.repeat(np.arange(len(segs)), size), np.cumsum(size)
    begin, room = stop - size, np.repeat(stop, size) - np.arange(len(chars))
    ids, after = np.full(len(chars), -1), np.arange(1, len(chars) + 1)
    at, h, k, edge = np.arange(len(chars)), _hash(np.zeros(len(chars), np.uint64), chars), 1, []
    while len(at):  # the substrings of k characters, joined to the pieces of that length
        if k in table:
            held, hashes, letters, number, rank = table[k]
            hit = np.flatnonzero(held[_place(h)])  # most substrings are no piece
            x = np.minimum(hashes.searchsorted(h[hit]), len(hashes) - 1)
            same = hashes[x] == h[hit]
            x, s = x[same], at[hit[same]]
            same = (letters[x] == chars[s[:, None] + np.arange(k)]).all(axis=1)
            x, s = x[same], s[same]
            if k == 1:
                ids[s] = number[x]
            else:
                edge.append((s, s + k, number[x], rank[x]))
        k += 1
        if k > max(table, default=0):
            break
        more = room[at] >= k
        at = at[more]
        h = _hash(h[more], chars[at + k - 1])
    if edge:
        s, e, number, rank = (np.concatenate(x) for x in zip(*edge, strict=True))
        order = np.lexsort((e, s, rank, own[s]))
        s, e, number = s[order], e[order], number[order]
        count = np.bincount(own[s], minlength=len(segs))
        first = np.cumsum(count) - count
        by = np.argsort(-count, kind="stable")
        first, count = first[by], -count[by]
        for turn in range(-count[0]):
            i = first[: count.searchsorted(-turn)] + turn  # of the segments with more than ``turn`` edges
            x, y = s[i], e[i]
            middle = after[x]
            fits = (middle > 0) & (middle < y)
            fits[fits] = after[middle[fits]] == y[fits]
            x, middle = x[fits], middle[fits]
            after[x], ids[x], after[middle] = y[fits], number[i[fits]], -1
    left = np.flatnonzero(after > 0)
    got, width = ids[left], np.ones(len(left), np.int64)
    bare = got < 0  # characters without a piece: their bytes
    c = chars[left[bare]]
    width[bare] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
    flat = np.repeat(got, width)
    flat[flat < 0] = bytes_from + np.frombuffer(c.tobytes().decode("utf-32-le").encode(), np.uint8).astype(np.int64)
    ends = 4 * np.cumsum(np.bincount(own[left], width, len(segs)).astype(np.int64))
    data = flat.astype("<i4").tobytes()
    return [data[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


# --------------------------------------------------------------------------- documents


def _digest(seg: str) -> bytes:
    return xxhash.xxh3_128_digest(seg.encode("utf-8", "surrogatepass"))


def pack_batches(batches):
    """For mapInArrow over (seg, ids): key (a 128-bit digest), ids (4 bytes each)."""
    for b in batches:
        keys = [_digest(s) for s in b.column(0).to_pylist()]
        flat, ends = np.asarray(b.column(1).flatten(), "<i4"), np.asarray(b.column(1).value_lengths()).cumsum()
        packed = [flat[e - n : e].tobytes() for e, n in zip(ends, b.column(1).value_lengths().to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(packed, pa.binary())], names=["key", "ids"])


def _head(counts: DataFrame, model: Model, most: int) -> tuple:
    """The most frequent segments, of ``most`` bytes at most: sorted keys, ends and ids.

    Frequencies are taken in steps of an eighth of a doubling; a step is in the head whole or not at all. A segment has an id
    for each of its bytes, at most.
    """
    step = F.floor(8 * F.log2(F.col("n")))
    by = counts.groupBy(step.alias("b")).agg(F.sum(F.octet_length("seg") * 4 + ENTRY).alias("bytes")).collect()  # 500 rows at most
    total, least = 0, None
    for r in sorted(by, key=lambda r: -r["b"]):
        total += r["bytes"]
        if total > most:
            break
        least = r["b"]
    empty = np.empty(0, "V16"), np.zeros(1, np.int64), b""
    if least is None:
        return empty
    rows = segment_table(counts.filter(step >= least), model)
    rows = rows.select("seg", "ids").mapInArrow(pack_batches, "key binary, ids binary").toArrow()
    if not rows.num_rows:
        return empty
    # plain buffers: an entry is ENTRY bytes and its ids
    keys = np.frombuffer(rows.column(0).combine_chunks().buffers()[2], "V16", count=rows.num_rows)
    order = np.argsort(keys.view(np.uint64).reshape(-1, 2)[:, 0], kind="stable")
    keys = keys[order]
    ids = rows.column(1).combine_chunks()
    del rows  # one copy of the ids at a time
    ids = ids.take(pa.array(order))
    ends = np.frombuffer(ids.buffers()[1], np.int32, count=len(ids) + 1).astype(np.int64)
    return keys, ends, ids.buffers()[2].to_pybytes()


class _Encoder:
    """A task's ids of words: of those it met, by the dictionary, or by the lattice of their segments."""

    def __init__(self, head, pairs, table, plain):
        self.keys, self.ends, self.ids = head
        halves = self.keys.view(np.uint64).reshape(-1, 2)
        self.first, self.second = np.ascontiguousarray(halves[:, 0]), np.ascontiguousarray(halves[:, 1])
        self.pairs, self.table, self.model, self.scores = pairs, table, Model(*plain), None
        self.known, self.old, self.met = {}, {}, {}

    def _find(self, segs: list[str]) -> list[bytes | None]:
        """The ids of segments; None where the dictionary has none."""
        found = [None] * len(segs)
        if not segs or not len(self.first):
            return found
        want = np.frombuffer(b"".join(map(_digest, segs)), np.uint64).reshape(-1, 2)
        at = self.first.searchsorted(want[:, 0])
        left = np.arange(len(segs))
        while len(left):  # keys that begin alike are neighbours
            left = left[at[left] < len(self.first)]
            left = left[self.first[at[left]] == want[left, 0]]
            hit = self.second[at[left]] == want[left, 1]
            k = at[left[hit]]
            for i, x, y in zip(left[hit].tolist(), self.ends[k].tolist(), self.ends[k + 1].tolist(), strict=True):
                found[i] = self.ids[x:y]
            left = left[~hit]
            at[left] += 1
        return found

    def _meet(self, segs: list[str]) -> None:
        """Makes ``met`` hold the ids of these segments."""
        if len(self.met) > CACHE:
            self.met = {}
        new = list(set(segs).difference(self.met))
        self.met.update(zip(new, self._find(new), strict=True))
        rest = [s for s in new if self.met[s] is None]
        if self.model.merges:
            short = [s for s in rest if len(s) <= LONG]
            self.met.update(zip(short, folded(short, self.table, self.model.bytes_from), strict=True))
            rest = [s for s in rest if len(s) > LONG]
        if rest:
            self.scores = self.scores or {p: (i, score) for p, i, score in self.model.pieces}
            self.met.update((s, np.array(ids_along(s, self.scores, self.model), "<i4").tobytes()) for s in rest)

    def learn(self, texts: list[list[str]]) -> None:
        """Makes ``known`` hold the ids of these texts' words."""
        if len(self.known) > CACHE:
            self.known, self.old = {}, self.known
        words = set().union(*texts).difference(self.known)
        again = words & self.old.keys()
        self.known.update(zip(again, map(self.old.__getitem__, again)))
        fresh = list(words - again)
        segs, firsts = segments_of(fresh, self.pairs)
        self._meet(segs)
        found = list(map(self.met.__getitem__, segs))
        for w, x, y in zip(fresh, firsts, firsts[1:]):
            self.known[w] = found[x] if y - x == 1 else b"".join(found[x:y])


def _groups(texts):
    """The words of consecutive texts, of GROUP characters together."""
    held, size = [], 0
    for t in texts:
        t = t.as_py()
        held.append(words_of(t))
        size += len(t)
        if size > GROUP:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode_batches(shared):
    """For mapInArrow over (_id, text): _id, text, ids."""

    def run(batches):
        encoder = _Encoder(*shared.value)
        for b in batches:
            ids = []
            for group in _groups(b.column(1)):
                encoder.learn(group)
                ids.extend(b"".join(map(encoder.known.__getitem__, ws)) for ws in group)
            ends = np.cumsum([0] + [len(x) // 4 for x in ids]).astype("<i4")
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists], names=["_id", "text", "ids"])

    return run


def decode(ids: Column, model: Model) -> Column:
    """The text of an array of ids."""
    table = F.split(F.lit(",".join(model.hexes)), ",")  # folded to one constant array
    code = F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")
    return F.substr(F.replace(F.decode(F.unhex(code), "UTF-8"), F.lit(MARK), F.lit(" ")), F.lit(2))


def encode_documents(docs: DataFrame, model: Model | None = None, head: int = HEAD) -> DataFrame:
    """doc_id, n_pieces, ids, decoded (the ids give the text back): one row per document."""
    spark: SparkSession = prepare(docs.sparkSession)
    model = model or Model.load()
    docs = docs.select(F.col("doc_id").alias("_id"), text_of().alias("text"))
    kind = docs.schema["_id"].dataType.simpleString()
    pairs = model.pairs
    counts = docs.select("text").mapInArrow(count_batches(pairs), "seg string, n long").groupBy("seg").agg(F.sum("n").alias("n"))
    common = _head(materialise(counts, "segments"), model, head)
    plain = (model.pieces, model.bytes_from, [], model.unknown, model.longest, model.merges)
    shared = spark.sparkContext.broadcast((common, pairs, piece_table(model), plain))
    out = docs.mapInArrow(encode_batches(shared), f"_id {kind}, text string, ids array<int>")
    back = F.when(F.size("ids") > 0, decode(F.col("ids"), model)).otherwise("")
    return out.select(
        F.col("_id").alias("doc_id"), F.size("ids").cast("long").alias("n_pieces"), "ids",
        (back == F.replace(F.col("text"), F.lit(MARK), F.lit(" "))).alias("decoded"),
    )
