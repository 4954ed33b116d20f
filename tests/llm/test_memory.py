import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.types import StringType, StructField, StructType

import corpus_pipeline
from pathloom.llm import common, language_id, packing, pieces, quality
from pathloom.llm.pieces import tokenizer_path


class Caught:
    """Stands for a frame and keeps the kernel that it is given."""

    schema = StructType([StructField("text", StringType())])

    def drop(self, *names):
        return self

    select = drop

    def mapInArrow(self, run, schema):  # noqa: N802
        self.run = run
        return self

    mapInPandas = mapInArrow  # noqa: N815


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(map("".join, rng.choice(list("abcdefghij"), (n, 5))))


def test_texts_are_scored_in_small_parts(monkeypatch):
    own = [words(20_000, i) for i in range(40)] + [None, ""]  # 4.8 MB
    net = language_id.ByteNetwork.fresh(["de", "en"])
    seen, scorer = [], language_id.ByteNetwork.scorer

    def counted(self):
        score = scorer(self)
        return lambda x: (seen.append(len(x)), score(x))[1]
    monkeypatch.setattr(language_id.ByteNetwork, "scorer", counted)
    frame = Caught()
    language_id.with_language(frame, net)
    out = list(frame.run(iter([pa.record_batch([pa.array(own)], ["text"])])))
    assert max(b.nbytes for b in out) < 1.1 * common.PART_BYTES < sum(b.nbytes for b in out)
    assert [t for b in out for t in b.column("text").to_pylist()] == own
    assert max(seen) < 2 * language_id.AT_ONCE <= 128
    lang, score = language_id.predict([t or "" for t in own], net, net.scorer())
    assert [v for b in out for v in b.column("lang_pred").to_pylist()] == lang
    np.testing.assert_allclose([v for b in out for v in b.column("score").to_pylist()], score, rtol=1e-5)

    quality.with_scores(frame, quality.SizeModel(b"", b"", 0.5))
    out = list(frame.run(iter([pa.record_batch([pa.array(own)], ["text"])])))
    assert len(out) > 2 and [v for b in out for v in b.column("score").to_pylist()] == [0.5] * 40 + [0.0] * 2


def test_a_task_keeps_no_encoder(spark, monkeypatch):
    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(len(pieces._encoders)))
    frame, path = Caught(), tokenizer_path(packing.VOCABULARY)
    packing.tokenized(frame, path)
    out = pd.concat(frame.run(iter([pd.DataFrame({"doc_id": [1, 2], "text": ["one two", ""]})])))
    assert out["doc_id"].tolist() == [1, 2] and out["doc_tokens"].tolist()[1] == 1
    assert given[0] == given[-1] == 0 and len(given) == 2 and not pieces._encoders


def test_pipeline_names_the_size_of_batches_once(spark):
    key, own = corpus_pipeline.BATCH_BYTES
    before = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        corpus_pipeline._small_batches(spark)
        assert spark.conf.get(key) == own
        spark.conf.set(key, "9m")
        corpus_pipeline._small_batches(spark)
        assert spark.conf.get(key) == "9m"
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
