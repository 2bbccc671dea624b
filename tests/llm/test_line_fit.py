"""What the line CRF is fitted on."""

import numpy as np

from gistmill.llm import linecrf


def test_fit_reads_all_lines_of_labelled_texts(spark, monkeypatch):
    calm, loud = "a plain line of some words here", "$$$ BUY!!! 99 ### NOW!!!"
    texts = [(k, "\n".join([f"{calm} {n}" for n in range(250)] + [f"{loud} {n}" for n in range(150)] * (k % 2))) for k in range(30)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(30)], "doc_id long, quality int")
    seen = []
    fit = linecrf.fit
    monkeypatch.setattr(linecrf, "fit", lambda wide, lengths, y: seen.append((wide, lengths, y)) or fit(wide, lengths, y))
    w, pair = linecrf.train(docs, labels)
    (wide, lengths, y) = seen[0]
    assert len(lengths) == labels.where(~linecrf.held_out(labels["doc_id"])).count()
    assert (lengths == np.where(y == 1, 250, 400)).all() and len(wide) == lengths.sum()
    model = linecrf.with_scores(docs, (w, pair)).collect()
    assert min(r.quality_score for r in model if r.doc_id % 2 == 0) > max(r.quality_score for r in model if r.doc_id % 2)
