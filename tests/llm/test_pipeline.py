"""The pipeline's stages, each held against plain Python (or its operator's checked rows) on its own input."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import brute  # noqa: E402
import corpus_pipeline  # noqa: E402
from ingot.llm import mixing, pieces, pii, quality  # noqa: E402
from ingot.llm.common import materialise, read  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = read(spark, SF, "documents")
    # a clean text beside personal data, a near copy, an exact copy, junk, and rows without text or source
    base = docs.filter("n_chars > 1500").orderBy("doc_id").first()
    extra = [
        (10**6, base.text, "en", base.source, base.n_chars), (10**6 + 1, base.text + " one more", "en", None, base.n_chars + 9),
        (10**6 + 2, " ".join(f"word{i}" for i in range(80)) + " mail me at a.b@mail.example.com please", "en", None, None),
        (10**6 + 3, "again and again " * 50, "en", "src1", 800), (10**6 + 4, None, None, None, None), (10**6 + 5, "", "en", "src1", 0),
    ]
    docs = docs.union(spark.createDataFrame(extra, docs.schema))
    out = [materialise(docs, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(materialise(stage(spark, out[-1], SF), name))
    return out


def test_names_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "pii", "source_mix", "sentencepiece"]
    assert all(s.columns == stages[0].columns for s in stages[:5])


def test_quality_stage(stages):
    verdict = {r.doc_id: r.kept for r in quality.quality(stages[0]).collect()}
    texts = {r.doc_id: r.text for r in stages[0].collect()}
    kept = {r.doc_id: r.text for r in stages[1].collect()}
    assert set(kept) == {i for i, k in verdict.items() if k}
    assert set(kept) == {i for i, t in texts.items() if not brute.quality(t)[-1]}  # no line is that frequent here
    assert all(kept[i] == texts[i] for i in kept)


def test_dedup_stage(stages):
    before = [(r.doc_id, r.text) for r in stages[1].collect()]
    groups = brute.near(before, 5)
    want = {i for i, (_, c) in groups.items() if i == c}
    got = [r.doc_id for r in stages[2].collect()]
    assert sorted(got) == sorted(want) and 10**6 not in got and 10**6 + 2 in got


def test_pii_stage(stages):
    spans = {r.doc_id: r.spans for r in pii.find_pii(stages[2]).collect()}
    before = {r.doc_id: r.text for r in stages[2].collect()}
    for r in stages[3].collect():
        text, at, parts = before[r.doc_id], 0, []
        for kind, s, e in (x.split(":") for x in spans[r.doc_id].split(",") if x):
            if int(s) >= at:
                parts += [text[at : int(s)], f"[{kind.upper()}]"]
            at = max(at, int(e))
        assert r.text == "".join(parts) + text[at:]
        assert brute.pii(r.text)[:4] == (0, 0, 0, 0)
        assert spans[r.doc_id] or r.text == text


def test_mix_stage(stages):
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mixture(stages[3]).collect()}
    got = Counter(r.doc_id for r in stages[4].collect())
    assert {i: n for i, n in want.items() if n} == got


def test_encoding_stage(stages):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    rows = stages[5].collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in stages[4].collect())
    assert all(r.ids == sp.encode(texts[r.doc_id]) and r.decoded for r in rows)


def test_empty_input(spark):
    docs = read(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.filter(F.lit(True)).count() == 0
