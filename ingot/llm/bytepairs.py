"""Operator 11: byte-pair encoding and decoding with forced boundaries.

1. A text is cut where the vocabulary's split pattern ends a word (found with array operations on the classes of code
   points), and, inside words, between two bytes that stand side by side in no token of the vocabulary: no merge can
   ever cross such a place. What is left between cuts are fragments, and each one's encoding depends on nothing else.
2. Each distinct fragment of a task is encoded once: those new to its dictionary together, one merge a round in each
   fragment, the lowest rank first and of equals the leftmost. Long fragments are merged one by one with a queue.
3. The fragments' ids, concatenated, are the text's. Nothing is shuffled; a task holds CHUNK bytes of text and a
   dictionary of bounded size, so texts of any length are read whole, and a lost task is simply run again.

Decoding concatenates the tokens' bytes and reads them as UTF-8, what isn't UTF-8 as U+FFFD.

The vocabulary's added tokens are found in the text first, as the library does. It is read on the driver and sent
to the tasks: some 3 MB, which the vocabulary's size bounds.

Edge cases: a null or empty text has no ids and decodes to the empty text; bytes that aren't UTF-8 count as U+FFFD;
repeated rows give equal rows; an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import json
import re
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ingot.llm.common import prepare, ships

ships(__name__)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
CHUNK = 1 << 22  # bytes of text cut at once
OUTPUT = 1 << 26  # bytes of text in an output batch, about
CACHE = 400_000  # fragments of a task's dictionary, at most
CACHE_BYTES = 1 << 25  # and their bytes
SHORT = 48  # bytes of the fragments that are merged together
SPACE, LETTER, NUMBER, OTHER = range(4)
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")  # fixed by the split pattern: what an apostrophe at a word's start keeps
NONE = np.iinfo(np.int32).max


def byte_letters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, or else one from 256 on."""
    shown = [b for a, z in ("!~", "¡¬", "®ÿ") for b in range(ord(a), ord(z) + 1)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class Vocabulary:
    """What tasks need: plain arrays."""

    classes: np.ndarray  # by code point
    inside: np.ndarray  # by two bytes: whether some token holds them side by side
    byte_id: np.ndarray
    pairs: np.ndarray  # of merges, sorted: left id * size + right id
    rank: np.ndarray  # of the sorted pairs
    joined: np.ndarray  # by rank: the id of the merged token
    size: int
    flat: np.ndarray  # the bytes of all tokens by id, concatenated
    ends: np.ndarray
    added: dict[bytes, int]

    @classmethod
    def load(cls, path: str = VOCABULARY) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        plain = not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if model["type"] != "BPE" or not plain or not level or spec["normalizer"] or spec["post_processor"]:
            raise ValueError("only plain byte-level vocabularies are supported")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("added tokens must match as they are")
        letters, ids = byte_letters(), model["vocab"]
        tokens = {i: bytes(letters[c] for c in t) for t, i in ids.items()}
        inside = np.zeros(1 << 16, bool)
        for t in tokens.values():
            b = np.frombuffer(t, np.uint8).astype(int)
            inside[b[:-1] * 256 + b[1:]] = True
        tokens |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        size = max(tokens) + 1
        pairs = np.array([ids[a] * size + ids[b] for a, b in merges], np.int64)
        order = np.argsort(pairs)
        rows = [tokens.get(i, b"") for i in range(size)]
        return cls(
            classes=point_classes(), inside=inside, size=size, pairs=pairs[order], rank=order.astype(np.int32),
            byte_id=np.array([ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])], np.int64),
            joined=np.array([ids[a + b] for a, b in merges], np.int64),
            flat=np.frombuffer(b"".join(rows), np.uint8), ends=np.cumsum([0, *map(len, rows)]),
            added={t["content"].encode(): t["id"] for t in spec["added_tokens"]},
        )

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or NONE."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.rank[at], NONE)


def point_classes() -> np.ndarray:
    """SPACE, LETTER, NUMBER or OTHER of each code point, by Unicode's properties."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000]
    every = "".join(points)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    return out


# --------------------------------------------------------------------------- cuts


def word_starts(points: np.ndarray, kind: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where words begin, by the split pattern; first: where a text, or the part after an added token, begins."""
    n = len(points)
    cut = first.copy()
    cut[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(cut)
    end = np.append(run[1:], n)
    # of white space before a word the last character stands alone, or goes with the word if it is a plain space
    before = (kind[run] == SPACE) & (end < n)
    before[before] &= ~first[end[before]]
    last, after = end[before] - 1, end[before]
    cut[last] = True
    cut[after[points[last] == 0x20]] = False
    # an apostrophe that begins a word takes some endings with it
    lone = run[(points[run] == 0x27) & (end - run == 1) & (end < n)]
    lone = lone[cut[lone] & ~first[lone + 1]]
    for tail in CONTRACTIONS:
        k = len(tail)
        at = lone[lone + k < n]
        for j, c in enumerate(tail, 1):
            at = at[(points[at + j] == ord(c)) & ~first[at + j]]
        cut[at + 1] = False
        cut[(at + k + 1)[at + k + 1 < n]] = True
    return cut


def fragment_starts(data: bytes, breaks: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The offsets at which fragments of ``data`` begin; breaks: those at which texts do."""
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero((b & 0xC0) != 0x80)
    points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
    first = np.zeros(len(at) + 1, bool)
    first[np.searchsorted(at, breaks)] = True
    cuts = np.zeros(len(b), bool)
    cuts[at[word_starts(points, v.classes[points], first[:-1])]] = True
    cuts[1:] |= ~v.inside[b[:-1].astype(np.intp) * 256 + b[1:]]
    return np.flatnonzero(cuts)


def pieces(texts: list[bytes], added: dict[bytes, int]):
    """(row, text, id): the texts in parts of CHUNK bytes, about, cut where a word surely begins; id: of an added token, or None."""
    words = re.compile(b"(?<=[!-~]) (?=[!-~])")
    special = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + b")") if added else None
    for row, text in enumerate(texts):
        for i, part in enumerate(special.split(text) if special and any(t in text for t in added) else [text]):
            if i % 2:
                yield row, part, added[part]
                continue
            start = 0
            while len(part) - start > CHUNK:
                m = words.search(part, start + CHUNK // 2)
                if not m:
                    break
                yield row, part[start : m.start()], None
                start = m.start()
            if start < len(part):
                yield row, part[start:] if start else part, None


# --------------------------------------------------------------------------- merges


def merge_together(fragments: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all fragments, concatenated, and how many each has."""
    size = np.fromiter(map(len, fragments), np.int64, len(fragments))
    sym = v.byte_id[np.frombuffer(b"".join(fragments), np.uint8)]
    own = np.repeat(np.arange(len(fragments)), size)
    rank = np.full(len(sym), NONE)
    pair = np.flatnonzero(own[1:] == own[:-1])
    rank[pair] = v.ranks(sym[pair], sym[pair + 1])
    out = []
    while len(sym):
        start = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        count = np.diff(np.append(start, len(own)))
        best = np.minimum.reduceat(rank, start)
        best = np.repeat(best, count)
        done = best == NONE
        out.append((own[done], sym[done]))
        sym, own, rank, best = (x[~done] for x in (sym, own, rank, best))
        hit = np.flatnonzero(rank == best)
        hit = hit[np.append(True, own[hit[1:]] != own[hit[:-1]])] if len(hit) else hit
        sym[hit] = v.joined[rank[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        sym, own, rank = sym[keep], own[keep], rank[keep]
        hit -= np.arange(len(hit))
        for at in (hit, hit[hit > 0] - 1):
            whole = at[at + 1 < len(own)]
            whole = whole[own[whole] == own[whole + 1]]
            rank[at] = NONE
            rank[whole] = v.ranks(sym[whole], sym[whole + 1])
    owner, ids = (np.concatenate([x[c] for x in out]) if out else np.empty(0, np.int64) for c in (0, 1))
    return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(fragments))


def merge_one(fragment: bytes, v: Vocabulary) -> np.ndarray:
    """The ids of one fragment of any length, with a queue of its pairs."""
    sym = v.byte_id[np.frombuffer(fragment, np.uint8)]
    n = len(sym)
    first = v.ranks(sym[:-1], sym[1:])
    queue = [(int(first[i]), int(i)) for i in np.flatnonzero(first < NONE)]
    heapq.heapify(queue)
    rank, sym, after, before = first.tolist() + [NONE], sym.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
    known = dict(zip(v.pairs.tolist(), v.rank.tolist(), strict=True))

    def again(i: int) -> None:
        j = after[i]
        rank[i] = known.get(sym[i] * v.size + sym[j], NONE) if j < n else NONE
        if rank[i] < NONE:
            heapq.heappush(queue, (rank[i], i))

    while queue:
        r, i = heapq.heappop(queue)
        if rank[i] != r:
            continue
        gone = after[i]
        sym[i], after[i], rank[gone] = int(v.joined[r]), after[gone], NONE
        if after[i] < n:
            before[after[i]] = i
        again(i)
        if before[i] >= 0:
            again(before[i])
    out, i = [], 0
    while i < n:
        out.append(sym[i])
        i = after[i]
    return np.array(out, np.int64)


@dataclass
class Dictionary:
    """A task's fragments with their ids."""

    v: Vocabulary
    code: dict[bytes, int] = field(default_factory=dict)
    at: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint32))
    held: int = 0

    def learn(self, new: list[bytes]) -> None:
        short = [x for x in new if len(x) <= SHORT]
        ids, counts = merge_together(short, self.v)
        rest = [x for x in new if len(x) > SHORT]
        more = [merge_one(x, self.v) for x in rest]
        self.code.update(zip(short + rest, range(len(self.code), len(self.code) + len(new)), strict=True))
        self.ids = np.concatenate([self.ids, ids.astype(np.uint32), *(x.astype(np.uint32) for x in more)])
        self.at = np.concatenate([self.at, self.at[-1] + np.cumsum([*counts.tolist(), *map(len, more)], dtype=np.int64)])
        self.held += sum(map(len, new))

    def encode(self, data: bytes, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of ``data``, and where those of each text begin."""
        start = fragment_starts(data, breaks, self.v)
        end = np.append(start[1:], len(data))
        found = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        if len(self.code) > CACHE or self.held > CACHE_BYTES:
            self.code, self.at, self.ids, self.held = {}, np.zeros(1, np.int64), np.empty(0, np.uint32), 0
        code = np.fromiter(map(self.code.get, found, repeat(-1)), np.int64, len(found))
        unknown = np.flatnonzero(code < 0).tolist()
        if unknown:
            self.learn(list(dict.fromkeys(found[i] for i in unknown)))
            code[unknown] = [self.code[found[i]] for i in unknown]
        begin, count = self.at[code], self.at[code + 1] - self.at[code]
        before = np.append(0, np.cumsum(count))
        ids = self.ids[np.repeat(begin - before[:-1], count) + np.arange(before[-1])]
        return ids, before[np.searchsorted(start, breaks)]


def encode_texts(texts: list[bytes], words: Dictionary) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, concatenated, and how many each has."""
    counts, out = np.zeros(len(texts), np.int64), []

    def flush(part: list[tuple[int, bytes]]) -> None:
        if not part:
            return
        breaks = np.cumsum([0, *(len(t) for _, t in part[:-1])])
        ids, begin = words.encode(b"".join(t for _, t in part), breaks)
        np.add.at(counts, [row for row, _ in part], np.diff(np.append(begin, len(ids))))
        out.append(ids)

    part, held = [], 0
    for row, text, special in pieces(texts, words.v.added):
        if held + len(text) > CHUNK or special is not None:
            flush(part)
            part, held = [], 0
        if special is not None:
            out.append(np.array([special], np.uint32))
            counts[row] += 1
        else:
            part.append((row, text))
            held += len(text)
    flush(part)
    return np.concatenate(out) if out else np.empty(0, np.uint32), counts


# --------------------------------------------------------------------------- tables


def packed(flat: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An array of binary values: ``counts`` bytes each of ``flat``."""
    ends = pa.py_buffer(np.append(0, np.cumsum(counts)).astype(np.int32).tobytes())
    return pa.Array.from_buffers(kind, len(counts), [None, ends, pa.py_buffer(flat.tobytes())])


def texts_of(column: pa.Array) -> list[bytes]:
    out = [x or b"" for x in column.cast(pa.binary()).to_pylist()]
    try:
        for x in out:
            x.decode("utf-8")
    except UnicodeDecodeError:
        out = [x.decode("utf-8", "replace").encode() for x in out]
    return out


def slices(sizes: list[int], most: int):
    """(from, to) of rows whose sizes sum up to ``most``, about."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)


def encode_batches(shared):
    """For mapInArrow over (doc_id, text): doc_id, n_tokens, ids (32 bits each, little-endian)."""

    def run(batches):
        words = Dictionary(shared.value)
        for b in batches:
            texts = texts_of(b.column(1))
            for i, j in slices([len(t) for t in texts], OUTPUT):
                ids, counts = encode_texts(texts[i:j], words)
                binary = packed(ids.astype("<u4").view(np.uint8), counts * 4, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts), binary], names=["doc_id", "n_tokens", "ids"])

    return run


def decode_batches(shared):
    """For mapInArrow over (doc_id, n_tokens, ids): those, and text. Ids that are no token's have no text."""

    def run(batches):
        v: Vocabulary = shared.value
        for b in batches:
            codes = [x or b"" for x in b.column(2).to_pylist()]
            for i, j in slices([len(x) for x in codes], OUTPUT):
                ids = np.frombuffer(b"".join(codes[i:j]), "<u4").astype(np.int64)
                counts = np.array([len(x) // 4 for x in codes[i:j]])
                ids = np.where(ids < v.size, ids, v.size)
                begin, size = np.append(v.ends[:-1], 0)[ids], np.append(np.diff(v.ends), 0)[ids]
                before = np.append(0, np.cumsum(size))
                data = v.flat[np.repeat(begin - before[:-1], size) + np.arange(before[-1])].tobytes()
                at = before[np.append(0, np.cumsum(counts))].tolist()
                text = pa.array([data[x:y].decode("utf-8", "replace") for x, y in zip(at[:-1], at[1:], strict=True)], pa.string())
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*part.columns, text], names=["doc_id", "n_tokens", "ids", "text"])

    return run


def share(docs: DataFrame, path: str = VOCABULARY):
    return prepare(docs.sparkSession).sparkContext.broadcast(Vocabulary.load(path))


def encode(docs: DataFrame, shared) -> DataFrame:
    """doc_id, n_tokens, ids (binary, 32 bits each, little-endian): one row per row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(encode_batches(shared), f"doc_id {kind}, n_tokens long, ids binary")


def decode(rows: DataFrame, shared) -> DataFrame:
    """The rows (doc_id, n_tokens, ids) with their text."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(decode_batches(shared), f"doc_id {kind}, n_tokens long, ids binary, text string")


def encoded(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: one row per document."""
    shared = share(docs, path)
    out = decode(encode(docs, shared), shared)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
