import gc
import weakref
from types import SimpleNamespace

import corpus_pipeline
import pyarrow as pa

from arborlake.llm import bpe
from arborlake.llm.common import map_slices, read

DIR = "/root/testdata/sf0.001"


class Plain:
    """Stands for a DataFrame and hands out the function that workers run."""

    sparkSession = SimpleNamespace(conf=SimpleNamespace(set=lambda *_: None))

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):
        return run


def test_a_task_lets_go_of_another_operators_table(spark):
    table = weakref.ref(bpe.load(bpe.vocabulary_path()))
    assert bpe.load(bpe.vocabulary_path()) is table()  # kept for the next task of its operator
    other = map_slices(Plain(), ["x"], lambda: lambda x: [x], "x bigint")
    assert pa.Table.from_batches(other([pa.record_batch({"x": [1, 2]})])).to_pydict() == {"x": [1, 2]}
    gc.collect()
    assert table() is None


def test_stages_begin_with_returned_heaps(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    whole = lambda: sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())
    docs = read(spark, DIR, "documents")
    for _, stage in corpus_pipeline.STAGES:
        before = whole()
        assert stage(spark, docs, DIR).columns
        assert whole() > before
