"""How many rows travel to a worker at once in the pipeline, and what a worker keeps."""

import gc
import weakref

import corpus_pipeline
import pyarrow as pa
import pytest

from veredas.llm.common import BATCH_ROWS, arrow_rows, gathered
from veredas.llm.pieces import Pieces

NAME = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize(("given", "left"), [("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("10", 10)])
def test_stages_bound_their_batches(spark, given, left):
    before = spark.conf.get(NAME)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(20)], "doc_id long, text string")
    try:
        for stage in (corpus_pipeline.quality_rules, corpus_pipeline.piece_encoding):
            spark.conf.set(NAME, given)
            stage(spark, docs, "")
            assert int(spark.conf.get(NAME)) == left
    finally:
        spark.conf.set(NAME, before)


def test_a_vocabulary_goes_with_its_last_reference():
    gc.disable()
    try:
        pieces = Pieces(["a", "b", "ab"], [0, 1, 2], [0, 1, 2], [3] * 256)
        assert pieces.best("ab")
        gone = weakref.ref(pieces)
        del pieces
        assert gone() is None
    finally:
        gc.enable()


@pytest.mark.parametrize(("given", "inside"), [("10000", "5"), ("0", "5"), ("3", "3")])
def test_batches_are_small_for_a_while(spark, given, inside):
    before = spark.conf.get(NAME)
    try:
        spark.conf.set(NAME, given)
        with pytest.raises(ZeroDivisionError), arrow_rows(spark, 5):
            assert spark.conf.get(NAME) == inside
            raise ZeroDivisionError
        assert spark.conf.get(NAME) == given
    finally:
        spark.conf.set(NAME, before)


def test_gathered_batches_hold_all_rows_in_order():
    batches = [pa.record_batch({"x": pa.array(range(3 * k, 3 * k + 3), type=pa.int64())}) for k in range(7)]
    got = list(gathered(iter(batches), 48))
    assert [len(b) for b in got] == [6, 6, 6, 3] and [x for b in got for x in b["x"].to_pylist()] == list(range(21))
    assert list(gathered(iter([]), 48)) == []
