"""Language-model scores of documents that are scored in several rounds."""

import random

import pytest

from foldwise.llm import pitman_yor


def test_pitman_yor_scores_alike_in_rounds(spark, monkeypatch):
    rnd = random.Random(5)
    rows = [(i % 70, " ".join(f"w{k}" for k in rnd.choices(range(40), k=20))) for i in range(90)] + [(None, None), (None, "w1 w2")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    calls = []
    requests = pitman_yor.block_requests
    monkeypatch.setattr(pitman_yor, "block_requests", lambda part, *a: calls.append(part.count()) or requests(part, *a))

    def scores():
        return sorted(((r.doc_id is None, r.doc_id, r.n_tokens, r.n_known, r.base_score, r.score)
                       for r in pitman_yor.score_documents(docs, frequent=5).collect()), key=str)

    one = scores()
    monkeypatch.setattr(pitman_yor, "ROUND_BYTES", 1000)
    parts = scores()
    assert len(calls) == 1 + pitman_yor.ROUNDS and sum(calls[1:]) == 92 and max(calls[1:]) < 92
    assert [x[:4] for x in parts] == [x[:4] for x in one]
    assert [x[4:] for x in parts] == [pytest.approx(x[4:]) for x in one]
