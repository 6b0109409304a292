"""The stages on a small fixture, each against what its plain version would do."""

import corpus_pipeline
from quadrat.llm import pii, simhash

from .test_text import corpus, plain_dropped


def test_pipeline(spark, tmp_path):
    rows = [(i, t, y) for i, t, y in corpus(160, 4)]
    repeated = "this passage stands in many documents and is longer than a few words"
    docs = [(i, f"{t}\n{repeated}" if i % 9 == 0 else t, "en", "s", len(t)) for i, t, _ in rows]
    docs += [(500, docs[3][1], "en", "s", 1), (501, "write to x.y@z.org about " + rows[5][1].replace("stupid", "a"), "en", "s", 1), (502, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in held.collect()}
        out = stage(spark, held, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            out.write.parquet(f"{tmp_path}/{name}")
            held = spark.read.parquet(f"{tmp_path}/{name}")
            after = {r.doc_id: r for r in held.collect()}
        if name == "toxicity":
            assert sum(y for i, _, y in rows if i in after) <= 3 and sum(1 - y for i, _, y in rows if i not in after) <= 3
        elif name == "line_dedup":
            gone = plain_dropped(sorted((d, r.text) for d, r in before.items()))
            assert {d: r.text for d, r in after.items()} == {d: r.text and "\n".join(x for k, x in enumerate(r.text.split("\n")) if (d, k) not in gone) for d, r in before.items()}
        elif name == "simhash_dedup":
            assert 500 not in after and all(before[d].text == r.text for d, r in after.items())
            prints = [simhash.fingerprint(r.text) & (2**64 - 1) for r in after.values()]
            assert all((a ^ b).bit_count() > 2 for i, a in enumerate(prints) for b in prints[:i])
        elif name == "pii":
            assert set(after) == set(before)
            assert all(not pii.base_spans(r.text or "") for r in after.values())
    packed = out.collect()
    assert {r.doc_id for r in packed} == set(after)
    assert sum(r.length for r in packed) <= 2048 * len({r.sequence_id for r in packed})
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in packed)
