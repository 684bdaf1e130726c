"""The pipeline's stages on a small table, each against its own operator's verdicts."""

import zlib

import corpus_pipeline as pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillspar.llm import decontam, jaccard, pii, queries, toxicity
from quillspar.llm.shared import settle

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").persist()
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())

    kept = stages["toxicity"](spark, docs, d)
    assert kept.columns == COLUMNS
    scores = queries.op4_kneser_ney_toxicity(spark, d)
    assert ids(kept) == ids(scores.where(F.col("score") < toxicity.REJECT_FROM))

    kept = stages["near_duplicates"](spark, docs, d)
    assert kept.columns == COLUMNS
    assert ids(kept) == ids(jaccard.jaccard_components(docs).where("doc_id = component_id"))

    kept = stages["decontamination"](spark, docs, d)
    assert kept.columns == COLUMNS
    assert ids(kept) == ids(decontam.digest(decontam.contamination(docs, spark.read.parquet(f"{d}/benchmark.parquet"))).where("not contaminated"))

    kept = settle(stages["personal_data"](spark, docs, d), "masked")
    assert kept.columns == COLUMNS and kept.count() == docs.count()
    assert not any(r.s for r in pii.spans(kept).select(F.expr(pii.joined(True)).alias("s")).collect())
    assert kept.where("n_chars <> length(text)").count() == 0


LONG = "one two three " * 40000 + "mail me at some.body@example.com"
ODD = [
    (1, None), (2, ""), (3, " \t"), (4, "only words here and nothing else at all"), (4, "only words here and nothing else at all"), (5, "only words here and nothing else at all"),
    (None, "no id, but a mail: a@b.com"), (None, None), (6, LONG), (7, "x"), (8, "call +49 30 1234567890 now"),
]


@pytest.mark.parametrize("empty", [False, True])
def test_stages_with_odd_rows(spark, empty):
    """Nulls, repeated ids and rows, long texts, no rows at all, and columns named as operators name their own; no n_chars."""
    rows = [] if empty else [(i, t, "kept", 1, 2.0, "s", n) for n, (i, t) in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string, id int, row double, toxic string, nth int")
    stages, d = dict(pipeline.STAGES), "/root/testdata/sf0.001"
    nth = lambda df: sorted(r.nth for r in df.collect())
    everything = list(range(len(rows)))
    for name, gone in (("toxicity", []), ("near_duplicates", [4, 5]), ("decontamination", []), ("personal_data", [])):
        got = stages[name](spark, docs, d)
        assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        assert nth(got) == [n for n in everything if empty or n not in gone], name
        if name != "personal_data":
            assert {(r.nth, r.text) for r in got.collect()} <= {(n, t) for n, (_, t) in enumerate(ODD)}
    masked = {r.nth: r for r in got.collect()}
    if not empty:
        assert masked[6].text == "no id, but a mail: [EMAIL]" and masked[8].text == LONG.replace("some.body@example.com", "[EMAIL]") and masked[0].text is None and masked[8].spans == "kept"
    pieces = stages["packing"](spark, docs, d).toPandas()
    assert sorted(set(pieces.columns)) == sorted(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket", "ids"])
    assert all(len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in pieces.itertuples())
    assert (pieces.length == 1).sum() >= (0 if empty else 3) and len(pieces) >= len(rows)


def test_run(spark):
    """The stages one after the other; the last one's ids give back the masked texts."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for _, stage in pipeline.STAGES[:-1]:
        docs = settle(stage(spark, docs, d), "by-hand")
    got = pipeline.run(spark, d).toPandas().sort_values(["doc_id", "start"])
    tool = Tokenizer.from_file(queries.word_tokenizer())
    assert (got.length <= 4096).all() and (got.offset == 0).all() and got.sequence_id.is_unique
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got.doc_id) == set(texts)
    for i, own in got.groupby("doc_id"):
        assert [x for ids in own.ids for x in ids] == [*tool.encode(texts[i] or "", add_special_tokens=False).ids, 2]
