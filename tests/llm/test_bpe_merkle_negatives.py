"""Byte pairs, Merkle manifest and hard negatives on small tables: against a public library and plain Python."""

import hashlib
import random
import sys
import zlib
from itertools import groupby
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ingot.llm import bytepairs, merkle, negatives  # noqa: E402
from test_operators import ODD, docs_of, prose  # noqa: E402


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --------------------------------------------------------------------------- 11


@pytest.fixture(scope="module")
def vocabulary():
    return bytepairs.Vocabulary.load()


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(bytepairs.VOCABULARY)


def ids_of(texts, vocabulary):
    ids, counts = bytepairs.encode_texts([t.encode() for t in texts], bytepairs.Dictionary(vocabulary))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_cuts_at_each_kind_of_character(vocabulary, library):
    kinds = vocabulary.classes
    edges = [i for i in range(1, len(kinds)) if kinds[i] != kinds[i - 1]]
    points = sorted({i + d for i in edges for d in (-1, 0)} - set(range(0xD800, 0xE000)))
    texts = [t.replace("%s", chr(i)) for i in points for t in ("a%sa", "1%s1 %s x", "!%s %s!")]
    assert ids_of(texts, vocabulary) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("chunk", [bytepairs.CHUNK, 64])
def test_ids_are_the_librarys(vocabulary, library, monkeypatch, chunk):
    monkeypatch.setattr(bytepairs, "CHUNK", chunk)
    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "'s", "'re", "'", "''", "'ll", "'l", "a", "bc", " the", "1", "23", "é", "😀", "\xa0", "\x85", "\x1c",
             "!", "?!", "<|endoftext|>", "<|endo", "x" * 30, "ve", "d's", "’s", "qzxj", "Ǆ", "٣", "한국어"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["x" * 100_000, "ab" * 30_000, " " * 50_000, " a" * 3000, "<|endoftext|>" * 50, "", " "]
    texts.append("".join(chr(rng.randrange(33, 127)) for _ in range(30_000)))
    assert ids_of(texts, vocabulary) == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def test_forced_cuts_stand_inside_no_token(vocabulary):
    data = b"qzxj vbkq the house"
    starts = set(bytepairs.fragment_starts(data, np.array([0]), vocabulary).tolist())
    for i in range(1, len(data)):
        a, b = data[i - 1], data[i]
        if not vocabulary.inside[a * 256 + b]:
            assert i in starts
    flat, ends = vocabulary.flat.tobytes(), vocabulary.ends
    assert all(vocabulary.inside[t[k] * 256 + t[k + 1]] for t in (flat[ends[i] : ends[i + 1]] for i in range(0, 50_000, 37)) for k in range(len(t) - 1))


def test_queue_and_rounds_merge_alike(vocabulary):
    rng = random.Random(9)
    words = [bytes(rng.choice(b"abehilnorstu") for _ in range(rng.randrange(1, 40))) for _ in range(2000)]
    ids, counts = bytepairs.merge_together(words, vocabulary)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [bytepairs.merge_one(w, vocabulary).tolist() for w in words]


def test_encoded_documents(spark, library):
    rows = [*ODD, (20, "<|endoftext|> and '<|endoftext|>'s", "a")]
    docs = docs_of(spark, rows)
    got = bytepairs.encoded(docs).collect()
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((-1 if i is None else i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(back)))
    assert sorted((-1 if r[0] is None else r[0], *r[1:]) for r in got) == sorted(want)
    assert bytepairs.encoded(docs.limit(0)).count() == 0


def test_dictionary_that_is_full_starts_anew(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bytepairs, "CACHE", 10)
    words = bytepairs.Dictionary(vocabulary)
    for seed in range(5):
        text = prose(seed, 300)
        assert bytepairs.encode_texts([text.encode()], words)[0].tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(words.code) <= 300


def test_decoding_what_is_no_text(spark):
    shared = bytepairs.share(spark.createDataFrame([], "doc_id long, text string"))
    half = np.array([int(shared.value.byte_id[0xF0]), 10**6], "<u4").tobytes()  # the start of a character; no token
    rows = spark.createDataFrame([(1, 2, bytearray(half)), (2, 0, None)], "doc_id long, n_tokens long, ids binary")
    assert {r["doc_id"]: r["text"] for r in bytepairs.decode(rows, shared).collect()} == {1: "�", 2: ""}


# --------------------------------------------------------------------------- 13


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def plain_tree(leaves):
    """(root, path of each leaf: its siblings by level, as (left, right))"""
    paths, level, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(level) > 1:
        for path, i in zip(paths, at, strict=True):
            s = i - i % 16
            path.append(("".join(level[s:i]), "".join(level[i + 1 : s + 16])))
        level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
        at = [i // 16 for i in at]
    return level[0], paths


def plain_manifest(rows):
    """Per row (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), sorted."""
    def leaf(r, text):
        return sha("".join(field(x) for x in (r[0], r[2], r[3], r[4], text)))

    def key(r):
        return (r[2] is not None, (r[2] or "").encode())

    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    groups = []
    for _, members in groupby(sorted(rows, key=key), key):
        mine = []
        for r in members:
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            mine.append((r[0] is not None, r[0] or 0, leaf(r, r[1]), leaf(r, r[1].translate(lower)) if hit else leaf(r, r[1]), r[0]))
        mine.sort()
        groups.append((mine, *plain_tree([m[2] for m in mine])))
    if not groups:
        return []
    root, tops = plain_tree([g[1] for g in groups])
    out = []
    for (mine, subroot, paths), top in zip(groups, tops, strict=True):
        for m, path in zip(mine, paths, strict=True):
            now = m[3]
            for left, right in path + top:
                now = sha(left + now + right)
            out.append((m[4], m[2], subroot, root, sha("".join(a + b for a, b in path + top)), now, now == root))
    return sorted(out, key=str)


def table(spark, rows):
    full = [(i, t, s, lang, n, "x", "y") for i, t, s, lang, n in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, lang string, n_chars long, leaf string, g string").repartition(3)


ODD_ROWS = [(i, t, s, "en" if i != 4 else None, None if t is None else len(t)) for i, t, s in ODD]


@pytest.mark.parametrize("rows", [
    ODD_ROWS, [], [(1, "Alone", None, None, 5)], [(i, f"T{i}", f"s{i % 40:02}", "en", 2) for i in range(90)],
    [(i, f"T{i}", "hot" if i % 3 else f"é{i % 7}", "en", 2) for i in range(5000)], [(7, "Same", "a", "en", 4)] * 300,
])
def test_manifest(spark, rows):
    got = sorted((tuple(r) for r in merkle.verified(table(spark, rows)).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_of_several_rounds(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)  # blocks of one run: a round for each level
    monkeypatch.setattr(merkle, "BLOCK", 16)
    rows = [(i, f"T{i}", "ab"[i % 7 == 0], "en", 2) for i in range(1200)]
    got = sorted((tuple(r) for r in merkle.verified(table(spark, rows)).collect()), key=str)
    assert got == plain_manifest(rows)


def test_manifest_tells_null_from_empty(spark):
    root = {merkle.verified(table(spark, [(1, t, "a", "en", 0), (2, "x", "a", "en", 1)])).first()["root"] for t in (None, "", "-")}
    assert len(root) == 3


# --------------------------------------------------------------------------- 12


def plain_negatives(rows):
    data = set()
    for i, label, x in rows:
        if i is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        data.add((i, (label + 1) % 10 if i % 7 == 0 else label, tuple(int(np.floor(256 * np.float64(c))) for c in x)))
    out = []
    for a in (d for d in data if d[0] % 100 == 0):
        score = lambda d: max(-(2**63), min(2**63 - 1, sum(x * y for x, y in zip(a[2], d[2], strict=True))))
        others = sorted((-score(d), d[0], d[1]) for d in data if d[0] != a[0] and len(d[2]) == len(a[2]))
        for p, i, _ in [o for o in others if o[2] == a[1]][:5]:
            fit = [o for o in others if o[2] != a[1] and 30 * -p <= 100 * -o[0] <= 90 * -p][:10]
            out += [(a[0], i, r, o[1], -p, -o[0]) for r, o in enumerate(fit, 1)]
    return sorted(out)


def vector_table(spark, rows, kind="double"):
    full = [(i, label, x, "x", "y", 0) for i, label, x in rows]
    return spark.createDataFrame(full, f"vec_id long, label int, embedding array<{kind}>, row string, block string, n int").repartition(3)


def random_rows(n, dim=16, seed=3, spread=0.4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + spread * rng.normal(size=(n, dim))
    return [(i, int(rng.integers(0, 10)), [float(c) for c in v / np.linalg.norm(v)]) for i, v in enumerate(x)]


@pytest.mark.parametrize("block", [negatives.BLOCK, 64])
def test_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", 4)
    rows = random_rows(1500)
    got = sorted(tuple(r) for r in negatives.mined(vector_table(spark, rows)).collect())
    assert got == plain_negatives(rows) and got


def test_negatives_of_copies_and_ties(spark):
    base = random_rows(40, dim=9, seed=4)
    rows = [(i, i % 3, base[0][2] if i % 2 else base[i % 40][2]) for i in range(600)]
    got = sorted(tuple(r) for r in negatives.mined(vector_table(spark, rows)).collect())
    assert got == plain_negatives(rows) and got


def test_negatives_odd_rows(spark):
    rows = [(i, i % 2, [1.0, 0.1 * (i % 11), -0.5]) for i in range(40)]
    rows += [(100, 1, [1.0, 0.5, 0.5]), (100, 1, [1.0, 0.5, 0.5]), (200, 0, [1.0, 2.0]), (201, 0, [0.5, 2.0]), (202, 1, [0.4, 2.0]), (300, 1, [])]
    rows += [(None, 1, [1.0, 1.0, 1.0]), (41, None, [1.0, 1.0, 1.0]), (42, 1, None), (43, 1, [1.0, None, 1.0]), (44, 1, [1.0, float("nan"), 1.0])]
    rows += [(45, 1, [float("inf"), 1.0, 1.0]), (400, 1, [-1.0, 0.0, 0.0]), (46, 0, [0.0, 0.0, 0.0])]
    got = sorted(tuple(r) for r in negatives.mined(vector_table(spark, rows)).collect())
    assert got == plain_negatives(rows)
    assert negatives.mined(vector_table(spark, rows).limit(0)).count() == 0


def test_negatives_of_large_components(spark):
    rows = [(100 * (i % 5 == 0) * (i + 1) or i + 1, i % 3, [1e10 + i, 3e9 * (i % 4)]) for i in range(30)]
    assert sorted(tuple(r) for r in negatives.mined(vector_table(spark, rows)).collect()) == plain_negatives(rows)


def test_index_drops_no_pair_and_omits_covered_slabs():
    x = np.floor(256 * np.array([r[2] for r in random_rows(400, dim=64)]))
    index = negatives.Index(x)
    for share in (0.95, 0.5, 0.1, -2.0):
        low = np.full(7, share * 65000.0)
        i, j, score = index.find(x[:7], low)
        whole = x[:7] @ x.T
        assert {(a, b) for a, b, s in zip(i, j, score, strict=True) if s >= low[0]} == set(zip(*np.nonzero(whole >= low[0]), strict=True))
        assert (score == whole[i, j]).all()
    covered = index.rest * index.norms(x[:7][:, index.order]).max(axis=0) < 0.95 * 65000
    assert covered[:, :-1].any()  # with a high threshold some slabs aren't in the postings
