"""The corpus pipeline stage by stage, and as a whole, on a small table."""

from __future__ import annotations

import numpy as np

import corpus_pipeline


def test_stages_keep_columns_and_take_effect(spark, tmp_path):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}{c}" for a in ("ba", "ko", "mi") for b in ("ran", "tel") for c in ("do", "sun", "va", "ip")]
    rows, labels = [], []
    for i in range(300):
        text = list(rng.choice(words, 60))
        if i % 7 == 0:
            text[5] = "vermin"
        rows.append((i, " ".join(text) + (f" mail a{i}@b.example.org" if i % 11 == 0 else ""), "en", "h", 1, "more"))
        labels.append((i, 1, int(i % 7 == 0)))
    rows += [(400 + i, rows[i][1] + " end", "en", "h", 1, "more") for i in range(1, 5)]
    rows += [(500, None, "en", "h", None, "more"), (501, "", None, None, 0, "more"), rows[1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string"
                          ).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{n}"
        out.write.parquet(path)
        if name != "packing":
            assert out.columns == docs.columns
        docs = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
    clean = {i for i in range(300) if i % 7}
    assert clean <= kept["language_id"] and not {500, 501} & kept["language_id"]
    assert clean <= kept["toxicity"] and not {i for i in range(0, 300, 7)} & kept["toxicity"]
    assert kept["near_duplicates"] == clean
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/3").collect()}
    assert texts[11].text.endswith("mail [EMAIL]") and texts[11].n_chars == len(texts[11].text)
    assert kept["packing"] == clean
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()
