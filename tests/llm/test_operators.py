"""The operators on small tables: against plain Python, and the edge cases their docstrings define."""

import hashlib
import random
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
from ingot.llm import chat, html, minhash, mixing, mtree, pieces, pii, quality, sharding, sketch, warc  # noqa: E402

DOCS = "doc_id long, text string, source string, n_chars long, kept string, _row string, n string, ids string, bytes string"


def docs_of(spark, rows):
    """(doc_id, text, source) with extra columns whose names clash with the operators' own."""
    full = [(i, t, s, len(t or ""), "x", "y", "z", "u", "v") for i, t, s in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def prose(seed, n, words=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


ODD = [
    (1, None, None), (2, "", "a"), (3, "   \n\t ", "a"), (4, "one", "b"), (5, "ONE", "b"), (6, "two words", None),
    (7, prose(1, 30_000), "a"), (8, prose(1, 30_000), "a"), (9, "same line\n" * 200, "b"), (10, "x" * 100_000, "b"),
    (11, "9" * 100_000, "b"), (12, "é ü 😀 ▁ ﬁ\x00 　 nbsp\xa0here", "c"), (12, "é ü 😀 ▁ ﬁ\x00 　 nbsp\xa0here", "c"),
    (None, "no id at all", "c"), (13, prose(2, 60), "c"), (13, prose(3, 60), "c"),
]


def same_columns(out, df):
    assert out.columns == df.columns


# --------------------------------------------------------------------------- 10


def test_quality_base_figures(spark):
    got = quality.quality(docs_of(spark, ODD)).collect()
    want = sorted((-1 if i is None else i, *brute.quality(t)) for i, t, _ in ODD)
    assert sorted((-1 if r[0] is None else r[0], *r[1:7]) for r in got) == want
    assert all(not (r["kept"] and r["base_failed"]) for r in got)


def test_quality_removes_lines_of_many_documents(spark):
    shared = "Cookie notice number 17 of this site"
    rows = [(i, prose(i, 60) + "\n" + shared, "h1") for i in range(30)]
    rows += [(100 + i, f"line {i} " + shared.replace("17", str(i)), "h1") for i in range(3)]
    rows += [(200 + i, prose(500, 60) + "\nits own last line", "h1") for i in range(200)]  # one text, copied
    rows += [(500, "\n".join([shared] * 6) + "\n" + prose(600, 8), "h1")]  # little else: depleted
    rows += [(600 + i, prose(700 + i, 60) + "\n" + shared, "h2") for i in range(5)]  # another host, below the limit
    docs = docs_of(spark, rows)
    limits = {"min_docs": 20, "host_share": 0.0}
    got = {r["doc_id"]: r for r in quality.quality(docs, **limits).collect()}
    assert all(got[i]["n_removed"] == 1 and got[i]["kept"] for i in range(30))
    assert all(got[200 + i]["n_removed"] == 0 and got[200 + i]["kept"] for i in range(200))
    assert got[500]["n_removed"] == 1 and not got[500]["kept"]
    assert all(got[600 + i]["n_removed"] == 0 for i in range(5))
    left = quality.filter_quality(docs, **limits)
    same_columns(left, docs)
    texts = {r["doc_id"]: r for r in left.collect()}
    assert texts[3]["text"] == prose(3, 60) and texts[3]["n_chars"] == len(prose(3, 60)) and texts[3]["kept"] == "x"
    assert set(texts) == {i for i, r in got.items() if r["kept"]}


def test_quality_removes_a_block_of_shared_lines(spark):
    block = [f"menu {a}{b}" for a in "abcde" for b in "uvwxyz"]
    rows = [(i, "\n".join([*block, prose(i, 60)]), "h1") for i in range(40)]  # one line of its own each
    rows += [(100 + i, "\n".join([*block[:3], prose(500, 60)]), "h2") for i in range(40)]  # true copies
    docs = docs_of(spark, rows)
    limits = {"min_docs": 20, "host_share": 0.0}
    got = {r["doc_id"]: r["n_removed"] for r in quality.quality(docs, **limits).collect()}
    assert got == {i: 30 if i < 100 else 0 for i, _, _ in rows}
    texts = {r["doc_id"]: r["text"] for r in quality.filter_quality(docs, **limits).collect()}
    assert all(texts[i] == prose(i, 60) for i in range(40))


def test_quality_empty(spark):
    empty = docs_of(spark, []).limit(0)
    assert quality.quality(empty).count() == 0 and quality.filter_quality(empty).count() == 0


# --------------------------------------------------------------------------- 1

PRIVATE = [
    "a@b.c_d@e.f %x@y.zz a@b a@b. @x.y q@-.-", "mail a@b.co,c@d.ef", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.004 1.2.3", "999.1.2.3.4.5.6.7",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 12 34", "x4111111111111111x", "1" * 14 + " " + "0" * 16,
    "+1 (873) 555-4781 +12 +1234567890123456 +(1) 22 +1 2 3 4 5 6 7 8 9 0 ", "é😀 a@b.co 😀 1.2.3.4\n+49 30 1234567",
    "+14111111111111111", "call 873-555-4781 now", "ssn 123-45-6789", 'password="abcdefgh12345" x', "john [at] example [dot] com",
]


def test_pii_base_spans(spark):
    rows = [(i, t, "a") for i, t in enumerate(PRIVATE * 2)] + [(100 + k, t, s) for k, (_, t, s) in enumerate(ODD)]
    got = {r["doc_id"]: r for r in pii.find_pii(docs_of(spark, rows)).collect()}
    for i, t, _ in rows:
        r = got[i]
        assert (r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) == brute.pii(t), t[:80]
        for span in filter(None, r["spans"].split(",")):
            kind, s, e = span.split(":")
            assert kind in pii.KINDS and 0 <= int(s) < int(e) <= len(t)


def test_pii_further_spans_and_redaction(spark):
    good = [f"please call my phone ({200 + i}) 555-{1000 + i} today or mail x{i}@mail.example.com" for i in range(40)]
    bad = [f"in version {200 + i}-555-{1000 + i}x of section {i}" for i in range(40)]
    docs = docs_of(spark, [(i, t, "a") for i, t in enumerate(good + bad)])
    got = {r["doc_id"]: r for r in pii.find_pii(docs).collect()}
    assert all("phone:" in got[i]["spans"] and got[i]["n_phone"] == 0 for i in range(40))
    assert all(got[40 + i]["spans"] == "" for i in range(40))
    out = pii.redact(docs)
    same_columns(out, docs)
    texts = {r["doc_id"]: r for r in out.collect()}
    assert texts[3]["text"] == "please call my phone [PHONE] today or mail [EMAIL]" and texts[3]["n_chars"] == len(texts[3]["text"])
    assert texts[50]["text"] == bad[10]
    empty = docs_of(spark, []).limit(0)
    assert pii.find_pii(empty).count() == 0 and pii.redact(empty).count() == 0


def test_label_model_learns_reliability():
    # the third labeler is noise, the first two agree
    rows = [(0, (1, 1, v, 0), 50) for v in (-1, 1)] + [(0, (-1, -1, v, 0), 50) for v in (-1, 1)] + [(0, (1, -1, 1, 0), 2)]
    like = dict(zip([r[1] for r in rows], pii.label_model(rows), strict=True))
    assert like[1, 1, -1, 0] > 0.9 and like[-1, -1, 1, 0] < 0.1


# --------------------------------------------------------------------------- 7


def edited(text, seed, n):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_match_all_pairs(spark, shingle):
    base = [prose(1000 + k, 150, 3000) for k in range(4)]
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(100 + i, edited(base[0], i, 4)) for i in range(120)]  # a family around its middle
    rows += [(300 + i, edited(base[1], i, 30)) for i in range(20)]  # too far
    chain = base[2]
    for i in range(15):  # each near the one before it only
        chain = edited(chain, i, 5)
        rows.append((400 + i, chain))
    rows += [(500 + i, base[3]) for i in range(50)] + [(600, "one"), (601, "ONE"), (602, ""), (603, None), (604, None)]
    rows += [(1000 + i, prose(i, 100, 5000)) for i in range(100)]
    random.Random(5).shuffle(rows)
    got = minhash.near_duplicates(docs_of(spark, [(i, t, "a") for i, t in rows]), shingle=shingle).collect()
    want = brute.near(rows, shingle)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_in_many_cells(spark, monkeypatch):
    monkeypatch.setattr(minhash, "PER_BLOCK", 8)
    monkeypatch.setattr(sketch, "PAIRS", 20, raising=False)
    base = prose(1, 150, 3000)
    rows = [(i, edited(base, i, 12)) for i in range(150)]
    chain = base
    for i in range(30):
        chain = edited(chain, 900 + i, 6)
        rows.append((400 + i, chain))
    got = minhash.near_duplicates(docs_of(spark, [(i, t, "a") for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute.near(rows, 5)


@pytest.mark.parametrize("full", [False, True])
def test_near_duplicates_cells_are_bounded_on_both_sides(spark, monkeypatch, full):
    size = 40_000 if full else 1
    if full:  # cut by the bytes of the sets
        monkeypatch.setattr(minhash, "PER_BYTES", 10 * size, raising=False)
    else:
        monkeypatch.setattr(minhash, "PER_BLOCK", 10)
    groups = {b"y": (120, 40), b"z": (60, 0), b"s": (2, 1), b"o": (1, 90)}
    rows = [(y + b"%d" % i, y, i >= n) for y, (n, m) in groups.items() for i in range(n + m)]
    pairs = spark.createDataFrame(rows, "a binary, y binary, own boolean")
    column = "shingles" if full else "brief"
    facts = spark.createDataFrame([(a, b"x" * size) for a, _, _ in rows], f"set_id binary, {column} binary")

    def met(outside, inside):
        import pyarrow as pa

        x, y = (list(zip(t["a"].to_pylist(), t["y"].to_pylist(), strict=True)) for t in (outside, inside))
        both = [(a, b, len(x), len(y)) for a, g in x for b, h in y if g == h]
        names = {"a": pa.binary(), "b": pa.binary(), "n": pa.int64(), "m": pa.int64()}
        return pa.table({k: pa.array([r[i] for r in both], t) for i, (k, t) in enumerate(names.items())})

    got = minhash._links(pairs, facts, 80, "a binary, b binary, n long, m long", met).collect()
    assert max(r["n"] for r in got) <= 30 and max(r["m"] for r in got) <= 30
    seen = {frozenset((r["a"], r["b"])) for r in got}
    assert all(frozenset((a, b)) in seen for a, y, own in rows if not own for b, z, _ in rows if y == z)


def test_near_duplicates_odd_rows(spark):
    got = minhash.near_duplicates(docs_of(spark, ODD), shingle=2).collect()
    assert len(got) == len(ODD)
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[8] == 7 and by[5] == 4 and by[1] == 1 and by[2] == 2 and by[None] is None
    docs = docs_of(spark, ODD)
    out = minhash.drop_near_duplicates(docs, shingle=2)
    same_columns(out, docs)
    ids = [r["doc_id"] for r in out.collect()]
    assert sorted(x for x in ids if x) == [1, 2, 3, 4, 6, 7, 9, 10, 11, 12, 13, 13] and None in ids
    assert minhash.near_duplicates(docs_of(spark, []).limit(0)).count() == 0


def test_texts_that_share_an_id_are_judged_by_themselves(spark):
    near = prose(20, 80)
    rows = [(1, prose(10, 60), "a"), (2, prose(11, 60), "a"), (2, prose(12, 60), "a"), (3, prose(13, 60), "a"), (3, prose(14, 60), "a")]
    rows += [(5, near, "a"), (3, near + " more", "a"), (6, near, "a"), (3, near + " more", "b"), (7, "", "a"), (7, "", "a")]
    out = minhash.drop_near_duplicates(docs_of(spark, rows)).collect()
    got = sorted((r["doc_id"], r["text"]) for r in out)
    want = [(i, t) for i, t, _ in rows[:5]] + [(3, near + " more"), (7, ""), (7, "")]
    assert got == sorted(want)


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 2**63, 40).astype(np.uint64)])
    sk = sketch.sketches([np.unique(a), np.unique(b), a[:1], a[:1]])
    assert not (sk == sketch.EMPTY).any()
    assert abs((sk[0] == sk[1]).mean() - 360 / 440) < 0.15 and (sk[2] == sk[3]).all()


# --------------------------------------------------------------------------- 8 and 2, against their SQL


def oracle(sql, rows):
    import pandas as pd

    con = duckdb.connect()
    con.register("frame", pd.DataFrame(rows, columns=["doc_id", "text", "source"]))
    con.execute("create table documents as select doc_id::bigint as doc_id, text::varchar as text, source::varchar as source from frame")
    return con.sql(sql).fetchall()


def key(rows):
    return sorted(tuple("" if v is None else str(v) for v in r) for r in rows)


MIXED = [(i, prose(i, i % 90), f"s{i % 7}" if i % 9 else None) for i in range(400)] + [(900, None, "empty"), (901, "", "empty"), (None, "a b c", "s1")]


def test_mixing_matches_sql(spark):
    docs = docs_of(spark, MIXED)
    got = mixing.mixture(docs).collect()
    assert key(tuple(r) for r in got) == key(oracle(mixing.ORACLE, MIXED))
    times = {r["doc_id"]: r["taken"] // r["size"] if r["size"] else None for r in got}
    out = mixing.mix(docs)
    same_columns(out, docs)
    count = {}
    for r in out.collect():
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert all(count.get(i, 0) == n for i, n in times.items() if n is not None)
    assert mixing.mixture(docs_of(spark, []).limit(0)).count() == 0


def test_mixing_handles_repeated_rows_and_one_source(spark):
    got = mixing.mixture(docs_of(spark, [(1, "a b", "x")] * 6 + [(2, "c d", "x")])).collect()
    assert {r["target"] for r in got} == {21.0} and all(r["taken"] <= 2 * r["size"] for r in got)
    assert len({r["taken"] for r in got if r["doc_id"] == 1}) == 1


def test_mixing_meets_targets_where_rows_share_an_id(spark):
    rows = [(None if i % 5 < 3 else i, prose(1000 + i, 25), f"s{i % 4}") for i in range(400)]
    rows += [(7, prose(5000 + i, 25), "s0") for i in range(100)]
    got = mixing.mixture(docs_of(spark, rows).select("doc_id", "text", "source")).collect()
    assert key(tuple(r) for r in got) == key(oracle(mixing.ORACLE, rows))
    taken = {}
    for r in got:
        taken[r["source_size"], r["target"]] = taken.get((r["source_size"], r["target"]), 0) + r["taken"]
    assert all(abs(n - target) <= 25 for (_, target), n in taken.items())
    assert sum(taken.values()) == pytest.approx(1.5 * 500 * 25, rel=0.02)


@pytest.mark.parametrize("limit", [600, 5000, 10**9])
def test_shards_match_sql(spark, limit):
    got = sharding.shard_documents(docs_of(spark, MIXED), limit).select("doc_id", "bytes", "shard", "shard_bytes", "shard_docs", "oversized").collect()
    assert key(tuple(r) for r in got) == key(oracle(sharding.ORACLE.replace(str(sharding.LIMIT), str(limit)), MIXED))
    assert all(r["shard_bytes"] <= limit for r in got if not r["oversized"])


def test_shards_split_repeated_rows(spark, tmp_path):
    docs = docs_of(spark, [(5, "same text", "a")] * 300 + [(6, "x" * 1000, "a"), (None, None, None)])
    got = sharding.shard_documents(docs, 100).collect()
    assert len(got) == 302 and all(r["shard_bytes"] <= 100 or r["oversized"] and r["shard_docs"] == 1 for r in got)
    assert sharding.shard_documents(docs_of(spark, []).limit(0)).count() == 0
    shards = sharding.write_shards(docs, str(tmp_path / "out"), 100)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 302 and back.select("_shard").distinct().count() == shards.count()


# --------------------------------------------------------------------------- 4


def best_score(seg, model):
    table = {p: s for p, _, s in model.pieces}
    best = [0.0] + [float("-inf")] * len(seg)
    for e in range(1, len(seg) + 1):
        for s in range(max(0, e - model.longest), e):
            score = table.get(seg[s:e], model.unknown if e - s == 1 else None)
            if score is not None:
                best[e] = max(best[e], best[s] + score)
    return best[-1]


@pytest.mark.parametrize("head", [0, 40, 1200, 10**6])  # bytes
def test_pieces_match_the_library(spark, head):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    more = [(50, "Hello  world\nfoo é 😀 12345", "a"), (51, " lead and trail  ", "a"), (52, "a.b-c?d   e\t\t\n\n", "a"), (53, "日本語のテキスト ½ ² x²y", "a")]
    rows = ODD + more + [(60, prose(9, 3000), "a"), (61, "x" * 2000, "a"), (62, "abcabd" * 5000, "a"), (63, "the" * 90 + " é" + "in" * 129, "a")]
    got = pieces.encode_documents(docs_of(spark, rows), head=head).collect()
    want = sorted((-1 if i is None else i, sp.encode(t) if t else []) for i, t, _ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["ids"]) for r in got) == want
    assert all(r["decoded"] and r["n_pieces"] == len(r["ids"]) for r in got)


def test_best_path_is_the_best(spark):
    model = pieces.Model.load()
    segs = ["▁hello", "▁unbelievable", "▁ñandú", "▁▁▁foo", "...!!", "▁x😀y"[0:2], "▁internationalization"]
    lattice = pieces.edges(spark.createDataFrame([(s, 1) for s in segs], "seg string, n long"), model)
    table = {i: (p, s) for p, i, s in model.pieces}
    for r in lattice.withColumn("best", pieces.best_path(lattice["edges"])).collect():
        assert "".join(r["seg"][x["s"] : x["e"]] for x in r["best"]) == r["seg"]
        score = sum(table[x["id"]][1] if x["id"] >= 0 else model.unknown for x in r["best"])
        assert score == best_score(r["seg"], model)
    table = {p: (i, score) for p, i, score in model.pieces}
    for seg in (*segs, "unbelievable" * 30):  # the plain path of segments that are too long to fold
        found = [seg[s:e] for s, e in pieces.scored(seg, table, model)]
        assert "".join(found) == seg
        assert sum(table[x][1] if x in table else model.unknown for x in found) == best_score(seg, model)


def test_near_duplicates_shuffle_no_other_text(spark):
    """Rows that are surely kept pass beside the join that drops the copies, whatever their number."""
    copy = prose(800, 60)
    rows = [(i, prose(i + 900, 60), "a") for i in range(30)] + [(100 + i, copy, "a") for i in range(5)] + [(7, None, "b"), (None, copy, "b")]
    out = minhash.drop_near_duplicates(docs_of(spark, rows))
    parts = out._jdf.queryExecution().optimizedPlan().toString().split("Union")
    assert len(parts) == 2 and "LeftAnti" in parts[1].split("LeftOuter")[1]
    assert "LeftAnti" not in parts[1].split("LeftOuter")[0]
    assert sorted((-1 if r.doc_id is None else r.doc_id) for r in out.collect()) == [-1, *range(7), 7, 7, *range(8, 30), 100]


def test_pieces_shuffle_no_text(spark):
    """Whatever the dictionary holds, segments outside it are folded where their text is."""
    out = pieces.encode_documents(docs_of(spark, ODD), head=40)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "hashpartitioning" not in plan
    segs = ["▁hello", "▁unbelievable", "▁ñandú", "▁▁▁foo", "...!!", "▁x", "é日😀", "▁internationalization", "the" * 80]
    model = pieces.Model.load()
    table = spark.createDataFrame([(s, 1) for s in segs], "seg string, n long")
    want = {r["seg"]: np.array(r["ids"], "<i4").tobytes() for r in pieces.segment_table(table, model).collect()}
    assert dict(zip(segs, pieces.folded(segs, pieces.piece_table(model), model.bytes_from))) == want


def test_pieces_empty(spark):
    assert pieces.encode_documents(docs_of(spark, []).limit(0)).count() == 0


# --------------------------------------------------------------------------- 3

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header>Site <b>name</b></header>
<nav><ul><li><a href=/a>Home</a><li><a>News</a></ul></nav><div class="cookie-notice">We use cookies</div>
<article><header><h1>Head &amp; line</h1><span>by menu</span></header><p>First   par&eacute;graph with some <b>bold</b>
text in it that is long enough to be content.<p>Short.<div class="ad">Buy!</div><script>var x = "<p>no</p>";</script>
<ul><li>one<li>two</ul><form><input>Send</form><section id="comments"><p>A reader says hello and quite a lot more words</p></section></article>
<aside>Related things</aside><footer>&copy; 2024</footer></body></html>"""


def test_html_main_text():
    assert html.main_text(PAGE) == "Head & line\nFirst parégraph with some bold text in it that is long enough to be content.\nShort.\none\ntwo"
    flat = "<html><body><div id=nav><a>x</a><a>y</a></div><div id=c><p>" + "long words here " * 30 + "</p><p>tiny</p><p>" + "more words " * 30 + "</p></div></body></html>"
    assert html.main_text(flat).split("\n")[1] == "tiny" and "x" not in html.main_text(flat).split("\n")
    assert html.main_text(None) == html.main_text("") == html.main_text("<nav>a</nav>") == ""
    assert html.main_text("plain text only") == "plain text only"
    assert html.main_text("<article><p>cut of") == "cut of"


LONG = "words that are long enough to count as content in this page, "


@pytest.mark.parametrize("page, wanted", [
    # two articles side by side, each with some of the text
    (f"<body><nav><a>m</a></nav><article><p>{LONG * 6}</p></article><article><p>{LONG * 4}</p></article></body>", [LONG * 6, LONG * 4]),
    # names that only look like those of boilerplate
    (f'<article><h2 id="related-work">Related work</h2><p>{LONG * 5}</p></article>', ["Related work", LONG * 5]),
    (f'<article><div class="article-header">Part one</div><p>{LONG * 5}</p></article>', ["Part one", LONG * 5]),
    (f'<article><p>{LONG * 5}</p><div class="share-price">12.50</div><div class="share-buttons">Tell</div></article>', [LONG * 5, "12.50"]),
    (f'<div class="layout-with-sidebar"><article><p>{LONG}</p></article><div class="right-sidebar">More</div></div>', [LONG]),
    # without an article: a headline and a last section beside the body
    (f"<body><div><h1>Headline</h1></div><div><p>{LONG * 9}</p><p>{LONG * 9}</p></div><div><p>{LONG}</p></div></body>",
     ["Headline", LONG * 9, LONG * 9, LONG]),
    # reader comments
    (f'<article><p>{LONG * 5}</p><ol class="commentlist"><li>{LONG * 2}</li></ol></article>', [LONG * 5]),
    (f'<body><article><p>{LONG * 5}</p></article><ol class="commentlist"><li>{LONG * 3}</li></ol></body>', [LONG * 5]),
    (f'<article><p>{LONG * 5}</p><article class="comment"><p>{LONG}</p></article></article>', [LONG * 5]),
])
def test_html_regions_and_names(page, wanted):
    assert html.main_text(page) == "\n".join(x.strip() for x in wanted)


def test_html_planted_texts():
    """Pages put together at random from an article's blocks and boilerplate give just the blocks."""
    rng = random.Random(3)
    junk = [
        "<nav><ul><li><a href=x>home</a></li></ul></nav>", '<div class="ad">buy this</div>', "<aside>see also</aside>",
        "<form>name <input></form>", '<div id="cookie-notice">we use cookies</div>', "<script>var a = '<p>no</p>';</script>",
        '<section class="comments"><p>first comment of a reader</p></section>', "<!-- hidden -->", '<div role="navigation">menu</div>',
    ]
    for _ in range(200):
        blocks, body = [], []
        for i in range(rng.randint(1, 12)):
            text = " ".join(rng.choice(["alpha", "beta &amp;", "g&eacute;", "<b>bold</b>", "a<br>b", "&lt;i&gt;"]) for _ in range(rng.randint(1, 60)))
            tag = rng.choice(["p", "h2", "li", "blockquote", "div", "section"])
            plain = text.replace("&amp;", "&").replace("&eacute;", "é").replace("<b>", "").replace("</b>", "").replace("<br>", " ")
            blocks.append(plain.replace("&lt;", "<").replace("&gt;", ">"))
            body.append(f"<{tag}>  {text}\n</{tag}>")
            if rng.random() < 0.4:
                body.append(rng.choice(junk))
        around = lambda: "".join(rng.sample(junk, rng.randint(0, 4)))
        page = f"<html><body><header>Site</header>{around()}<article>{''.join(body)}</article>{around()}<footer>end</footer></body></html>"
        assert html.main_text(page) == "\n".join(blocks)


@pytest.mark.parametrize("page", [
    "<div>some text " * 20_000, "<a " * 100_000, "<!--" * 100_000, "<article>" * 20_000 + "x",
    "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<p>" + "<span hidden>" * 20_000 + "</b>" * 20_000,
])
def test_html_time_is_linear(page):
    began = time.process_time()
    html.main_text(page)
    assert time.process_time() - began < 5


def test_html_pages(spark):
    schema = "page_id long, url string, html string, text string"
    rows = [(1, "u", PAGE, "clash"), (1, "u", PAGE, "clash"), (2, None, None, ""), (None, "v", "<p>" + "a b " * 50_000, "")]
    got = {(r["page_id"], r["n_chars"]) for r in html.extract_pages(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, len(html.main_text(PAGE))), (2, 0), (None, 199_999)}
    assert html.extract_pages(spark.createDataFrame([], schema)).count() == 0


# --------------------------------------------------------------------------- 5


def test_mtree_takes_large_components(spark):
    x = [[1e10 * (i % 3 - 1), 4e9 + i] for i in range(60)]
    rows = [(i, v) for i, v in enumerate(x)]
    got = mtree.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), every=50, k=3)
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = []
    for q in (0, 50):
        score = [(-sum(int(a * 256) * int(b * 256) for a, b in zip(x[q], v, strict=True)), i) for i, v in rows if i != q]
        best = sorted((-hold(-s), i) for s, i in score)[:3]
        want += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    assert {(r[0], r[1], r[3]) for r in got.collect()} == {(q, r, s) for q, r, _, s in want}


def test_mtree_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(8, 12))
    rows = [(i, [float(x) for x in centres[i % 8] + 0.2 * rng.normal(size=12)], 0) for i in range(900)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(400)]  # one vector, often
    rows += [(2000, None, 0), (2050, [1.0, None], 0), (2100, [float("nan")] * 12, 0), (2150, [1.0, 2.0], 0), (2200, [3.0, -1.0], 0), (None, rows[1][1], 0)]
    rows += [rows[50], rows[51]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    plain = {}
    for i, v, _ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            plain[i] = np.floor(256 * np.array(v, np.float32).astype(float)).astype(int)
    want = []
    for q, x in plain.items():
        if q % 50 == 0:
            near = sorted((-int(x @ y), j) for j, y in plain.items() if j != q and len(y) == len(x))[:5]
            want += [(q, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    assert sorted(map(tuple, mtree.top_k(df).collect())) == sorted(want)
    assert mtree.top_k(df.limit(0)).count() == 0


# --------------------------------------------------------------------------- 6


def test_archive(spark, tmp_path):
    schema = "page_id long, url string, html string, digest string"
    rows = [(i, f"http://h/{i % 3}\r\nX: y", "same" if i % 2 else f"own {i} é", "clash") for i in range(40)]
    rows += [(100, None, None, ""), (101, "u", "", ""), (7, "again", "same", ""), (39, "again", "same", ""), (None, "n", "same", ""), (200, "big", "z" * 300_000, "")]
    df = spark.createDataFrame(rows, schema)
    archive = warc.write_archive(df, str(tmp_path / "a"))
    own = {}
    for i, _, h, _ in rows:
        own[h or ""] = max(own.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h, _ in rows:
        body = (h or "").encode()
        first = own[h or ""]
        want.append((i, len(body), warc.sha1_text(body), "response" if i == first else "revisit", None if i == first else first))
    assert key(tuple(r) for r in warc.read_index(spark, archive).collect()) == key(want)
    assert spark.read.parquet(archive.payloads).count() == len(own)
    for r in warc.read_records(spark, archive).filter("page_id in (0, 1, 39)").collect():
        body = dict((i, h) for i, _, h, _ in rows)[r["page_id"]].encode()
        revisit = r["page_id"] == 1
        head, rest = r["record"][: r["record"].index(b"\r\n\r\n") + 4], r["record"][r["record"].index(b"\r\n\r\n") + 4 :]
        assert rest == warc.HTTP + (b"" if revisit else body) + b"\r\n\r\n" and (b"Content-Length: %d\r\n" % (len(rest) - 4)) in head
        assert b"\r\nX: y" not in head
    assert warc.archived(df.limit(0)).count() == 0


def test_archive_refuses_a_wrong_payload(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "body")], "page_id long, url string, html string")
    a = warc.write_archive(df, str(tmp_path / "a"))
    bad = spark.read.parquet(a.payloads).collect()[0]["digest"]
    spark.createDataFrame([(bad, warc.gzip.compress(b"other"))], "digest binary, payload binary").write.parquet(str(tmp_path / "p"))
    with pytest.raises(Exception, match="does not have its digest"):
        warc.read_index(spark, warc.Archive(a.headers, str(tmp_path / "p"))).collect()


# --------------------------------------------------------------------------- 9


def test_chat_windows(spark):
    rng = random.Random(7)
    rows = []
    for c in (1, 2, None, 3):
        rows.append((c, 0, "system" if c != 2 else "user", "be # nice <b> \\", "x"))
        for t in range(1, 60):
            text = rng.choice(["### user: </turn>", "\\", "\\\\#", "a\nb", "", prose(t, rng.randrange(80)), None])
            rows.append((c, t, "assistant" if t % 2 else "us:er\n#", text, "x"))
    rows += [(4, 1, "assistant", "long " * 2000, "x"), (4, 1, "assistant", "long " * 2000, "x"), (4, None, None, "z", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string").repartition(4)
    windows = chat.format_conversations(df, budget=120, history_tokens=30).cache()
    for w in windows.collect():
        turns = chat.turns_of(w["text"])
        assert len(turns) == w["n_old"] + w["n_new"] and (chat.tokens(w["text"]) <= 120 or w["n_new"] == 1)
        if w["window"] and w["conv_id"] in (1, 3):
            assert turns[0] == ("system", "be # nice <b> \\")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(windows).collect()}
    groups = {}
    for c, t, r, x, _ in rows:
        groups.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    assert got == {c: brute.chat([g[2:] for g in sorted(gs)]) for c, gs in groups.items()}
    assert max(r["window"] for r in windows.collect()) > 5


def test_chat_query_rows(spark):
    got = chat.formatted(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect()
    want = brute.chat([(r, t) for _, _, r, t in chat.EXTRA])
    assert len(got) == 1 and tuple(got[0])[:5] == (-7, *want)
    assert hashlib.sha256(b"").hexdigest() != got[0]["loss_sha256"]
