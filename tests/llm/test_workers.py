"""What Python workers keep between tasks."""

import gc

import pyarrow as pa

from tessera import workers
from tessera.llm import line_dedup, packing, queries, toxicity


def caches_in_workers(spark):
    """The caches that live in the workers, by several tasks for each."""

    def look(batches):
        for batch in batches:
            pass
        found = [type(x).__name__ for x in gc.get_objects() if type(x).__name__ in ("TokenCache", "Distances")]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["name"])

    return [r.name for r in spark.range(0, 32, numPartitions=32).mapInArrow(look, "name string").collect()]


def test_workers_drop_what_other_operators_kept(spark):
    docs = spark.createDataFrame([(i, f"some text {i} of words\nand line {i} of it") for i in range(64)], "doc_id long, text string").repartition(16)
    labels = spark.createDataFrame([(i, i % 2) for i in range(64)], "doc_id long, toxic int")
    packing.pieces(docs, queries.tokenizer("word_bpe_49k.json")).collect()
    assert not caches_in_workers(spark)
    toxicity.classify(docs, labels).collect()
    assert caches_in_workers(spark)  # worth keeping for the next task of the same operator
    line_dedup._lines(docs.selectExpr("doc_id", "doc_id AS text_key", "text").repartition(64), 3).collect()
    assert not caches_in_workers(spark)


def test_lean_steps_give_the_same_batches_and_keep_on_request():
    batches = [pa.RecordBatch.from_arrays([pa.array([i, None])], names=["x"]) for i in range(3)]
    assert workers.kept("a", lambda: 1) == 1 and workers.kept("a", lambda: 2) == 1
    assert list(workers.lean(lambda b: b, keeps=True)(iter(batches))) == batches and workers.kept("a", lambda: 3) == 1
    assert list(workers.lean(lambda b: b)(iter(batches))) == batches and workers.kept("a", lambda: 3) == 3
    assert workers.kept("b", lambda: 4) == 4 and workers.kept("a", lambda: 5) == 5  # one value at a time


def test_pairs_of_near_copies_come_out_few_times(spark):
    import random

    from tessera.llm import simhash_golay

    rnd, signed = random.Random(5), lambda x: x - (1 << 64) if x >> 63 else x
    base = [rnd.getrandbits(64) for _ in range(4)]
    rows = [(i, *(signed(w ^ (1 << rnd.randrange(64))) for w in base)) for i in range(30)]
    distinct = spark.createDataFrame(rows, "node long, f0 long, f1 long, f2 long, f3 long")
    pairs = [(r.a, r.b) for r in simhash_golay.wide_candidates(distinct, 55, 64).filter("b IS NOT NULL").collect()]
    assert set(pairs) == {(a, b) for a in range(30) for b in range(a)}
    assert len(pairs) < 2 * len(set(pairs)), len(pairs)
