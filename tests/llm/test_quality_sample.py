"""The quality model learns from whole texts."""

from pathloom.llm import quality


def seen(monkeypatch, docs, labels):
    got = []
    monkeypatch.setattr(quality, "_dictionary", lambda t: got.extend(t) or b"".join(x.encode() for x in t)[:1000])
    monkeypatch.setattr(quality.SizeModel, "fit", lambda self, t, y, rounds=100: got.extend(t))
    quality.train(docs, labels)
    return sorted(got)


def test_long_texts_are_read_to_their_end(spark, monkeypatch):
    rows = [(i, f"{i} " + "word " * 9_000 + f"end {i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    mine = {r["doc_id"] for r in df.where(f"not ({quality.HOLD_OUT})").collect()}
    every = seen(monkeypatch, df.drop("quality"), df.drop("text"))
    assert every == sorted(t for i, t, _ in rows if i in mine)
    monkeypatch.setattr(quality, "SAMPLE_CHARS", 200_000)  # fewer texts, each whole
    fewer = seen(monkeypatch, df.drop("quality"), df.drop("text"))
    assert 8 <= len(fewer) < len(every) and set(fewer) < set(every)
