import zlib

import corpus_pipeline
from waypoint.llm import mixing, quality
from waypoint.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark, rows):
    docs = table(spark, SF, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_dedup", "mix", "pack"]
    labels = dict(rows("labels", "doc_id, quality"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == table(spark, SF, "documents").columns
        kept[name] = [r.doc_id for r in out.select("doc_id").collect()]
        docs = spark.createDataFrame(out.collect(), out.schema)
    before = {d for d, in rows("documents", "doc_id")}
    accepted = set(kept["quality"])
    scored = {r.doc_id: r.predicted for r in quality.scored(
        table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert accepted == {d for d in before if scored[d] == 1}
    assert all(labels[d] == 1 for d in accepted & labels.keys()) or len(
        [d for d in accepted & labels.keys() if labels[d] == 0]) <= 0.03 * len(labels)
    # one of each class of the accepted ones, by brute force
    from tests.llm.test_simhash import classes_of, plain
    texts = sorted((d, t) for d, t in rows("documents", "doc_id, text") if d in accepted)
    least = classes_of([plain(t) for _, t in texts])
    assert set(kept["near_dedup"]) == {texts[c][0] for c in least}
    assert len(kept["near_dedup"]) == len(set(kept["near_dedup"]))
    assert set(kept["mix"]) <= set(kept["near_dedup"]) and max(map(kept["mix"].count, set(kept["mix"]))) <= 2


def test_run_packs_what_the_mix_took(spark, rows):
    out = corpus_pipeline.run(spark, SF).collect()
    by_seq = {}
    for r in out:
        by_seq.setdefault(r.sequence_id, []).append(r)
    for ps in by_seq.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    from tests.llm.test_mixing_packing import tokenised
    texts = dict(rows("documents", "doc_id, text"))
    ids = {d: t for d, t in zip(texts, tokenised(list(texts.values())))}
    for d in {r.doc_id for r in out}:
        pieces = [r for r in out if r.doc_id == d]
        assert sum(r.length for r in pieces) in (len(ids[d]), 2 * len(ids[d]))
        assert all(zlib.crc32(ids[d][r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in pieces)


def test_stages_on_odd_and_empty_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            if name == "pack":
                assert out.count() >= docs.count()
            else:
                assert out.columns == docs.columns and out.count() <= 2 * docs.count()


def test_mix_stage_is_the_operator(spark):
    docs = table(spark, SF, "documents")
    a = sorted(r.doc_id for r in corpus_pipeline.mix(spark, docs, SF).collect())
    b = sorted(d for r in mixing.op4_mixing(spark, SF).collect() for d in [r.doc_id] * (r.taken // r.size if r.size else 0))
    sizeless = {r.doc_id for r in mixing.op4_mixing(spark, SF).collect() if not r.size}
    assert [d for d in a if d not in sizeless] == b
