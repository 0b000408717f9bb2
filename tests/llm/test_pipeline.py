"""The pipeline's stages, each against a plain version on its own input."""

import zlib

import corpus_pipeline
from tallyframe.llm import secrets
from tallyframe.sources import scratch

D = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").cache()
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality"](spark, docs, D)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    held = [(i in kept, y) for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 == 1]
    assert good.columns == columns and sum(k == bool(y) for k, y in held) >= 0.9 * len(held)
    cut = stages["lines"](spark, docs, D)
    assert cut.columns == columns and cut.count() == docs.count()
    near = stages["near copies"](spark, docs, D)
    from test_llm import brute_links

    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    assert sorted(r.doc_id for r in near.collect()) == [rows[i].doc_id for i, _, c in brute_links([r.text for r in rows]) if i == c]
    masked = {r.doc_id: r for r in stages["secrets"](spark, docs, D).collect()}
    assert all(masked[r.doc_id].text == secrets.masked(r.text, "[secret]") and masked[r.doc_id].n_chars == len(masked[r.doc_id].text) for r in rows)
    assert not any(secrets.find(r.text)[0] for r in masked.values())


def test_run(spark):
    out = corpus_pipeline.run(spark, D)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)


def test_near_copies_keep_the_only_holder_of_a_text(spark):
    a, b, c = "a b c d e f", "g h i j k l", "m n o p q r"
    rows = [(3, a), (5, a), (5, b), (5, ""), (9, b), (5, c), (2, c), (None, a)]
    left = corpus_pipeline.near(spark, spark.createDataFrame(rows, "doc_id long, text string"), D)
    assert left.columns == ["doc_id", "text"]
    assert sorted((r.doc_id or 0, r.text) for r in left.collect()) == [(0, a), (2, c), (3, a), (5, ""), (5, b)]


SHAPE = "doc_id long, text string, score double, predicted string, n_lines long, row_no string, lang string, n_chars long"


def odd(spark, rows):
    return spark.createDataFrame([(i, t, 0.125, "p", 7, "r", "x", -1) for i, t in rows], SHAPE)


def test_stages_on_nulls_repeats_and_clashing_columns(spark):
    line = "this very line is shared by a lot of documents"
    rows = [(None, None), (None, line), (1, None), (2, ""), (2, ""), *[(i, f"{line}\nbut nothing else {i} is in them " + f"w{i} " * 9) for i in range(3, 9)], (20, "word " * 60_000), (20, "a text of its own password = 'x1x1x1x1x1x1x1'")]
    docs = odd(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, D)
        assert out.schema.simpleString().replace("predicted:int", "") and out.columns == docs.columns, name
        got = out.collect()
        assert got and all((r.score, r.predicted, r.n_lines, r.row_no, r.lang) == (0.125, "p", 7, "r", "x") for r in got), name
        if name == "lines":
            assert [line in r.text for r in sorted((r for r in got if r.doc_id and 3 <= r.doc_id < 9), key=lambda r: r.doc_id)] == [False] * 5 + [True]
            assert sorted(r.text for r in got if r.doc_id is None) == ["", line] and all(r.n_chars == len(r.text) for r in got)
        if name == "near copies":
            assert sorted((r.doc_id or 0, (r.text or "")[:1]) for r in got if r.doc_id not in range(3, 9)) == [(0, ""), (0, "t"), (1, ""), (2, ""), (20, "a"), (20, "w")]
        if name == "secrets":
            assert len(got) == len(rows) and [r.text for r in got if r.doc_id == 1] == [None]
            assert "[secret]" in [r.text for r in got if r.doc_id == 20 and r.text.startswith("a text")][0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, D).collect()
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed) and sum(r.length for r in packed if r.doc_id == 2) == 2


def test_stages_on_empty_tables(spark):
    docs = odd(spark, [(1, "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, D).count() == 0


def test_scratch_of_stages_goes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, D)
    assert out.count() and len(list(tmp_path.iterdir())) <= len(corpus_pipeline.STAGES)  # the stages' own, and the last one's pieces
