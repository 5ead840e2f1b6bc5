"""The pipeline against its stages' operators, applied one after the other in plain Python on the driver."""

from __future__ import annotations

import numpy as np

import corpus_pipeline
from tests.conftest import SF
from tidemark.llm import languages, minhash, quality_rules
from tidemark.llm.packing import pieces_of
from tidemark.llm.tokens import Encoder, vocabulary_path


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    models = languages.fit(docs)
    rows = {r.doc_id: r.text for r in docs.collect()}
    scorer = languages.Scorer(models)
    rows = {k: t for k, t in rows.items() if not languages.judge(models, scorer.sums([t]))[3][0]}
    rows = {k: t for k, t in rows.items() if quality_rules._judge([t], quality_rules.Bands())[0][6]}
    frame = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    kept = {r.doc_id for r in minhash.near_duplicates(frame).where("kept").collect()}
    rows, first, out = {k: t for k, t in sorted(rows.items()) if k in kept}, {}, {}
    for k, t in rows.items():
        words = t.encode().split()
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), k)
    for k, t in rows.items():
        words = t.encode().split()
        gone = {j for i in range(len(words) - 49) if first[tuple(words[i : i + 50])] < k for j in range(i, i + 50)}
        out[k] = b" ".join(w for i, w in enumerate(words) if i not in gone).decode() if gone else t
    e = Encoder(vocabulary_path())
    want = {(k, i, s, n) for k, x in zip(out, e.encode(list(out.values())), strict=True) for i, (s, n) in enumerate(pieces_of(len(np.frombuffer(x, e.kind)) + 1, 1024))}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {(r.doc_id, r.piece, r.start, r.length) for r in got} == want
