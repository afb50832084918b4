"""Which texts hold which passages: a stated set of passages, in blocks, against all texts.

Each block becomes one automaton that a worker builds once and reads every text with, so
the work is linear in the texts and in what is found, however many passages there are.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of the passages in one block.
BLOCK = 1 << 20
_built: dict[str, object] = {}


def _automaton(held):
    """The block's automaton, kept by the worker."""
    if held.id not in _built:
        import ahocorasick

        listed: dict[str, list[int]] = {}
        for i, (_, passage) in enumerate(held.value):
            listed.setdefault(passage, []).append(i)
        made = ahocorasick.Automaton()
        for passage, places in listed.items():
            made.add_word(passage, places)
        made.make_automaton()
        _built.clear()
        _built[held.id] = made
    return _built[held.id]


class _Block:
    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def containing(texts: DataFrame, passages: DataFrame, id_col: str = "doc_id", key: str = "qid") -> DataFrame:
    """(qid, doc_id) for each text (doc_id, text) that holds a passage (qid, text), once; null and empty passages stand nowhere."""
    spark = texts.sparkSession
    asked = passages.filter(F.length("text") > 0).select(key, "text")
    total = asked.agg(F.sum(F.length("text"))).first()[0] or 0
    count = -(-total // BLOCK) or 1
    kinds = texts.schema[id_col].dataType, passages.schema[key].dataType
    schema = T.StructType([T.StructField(key, kinds[1]), T.StructField(id_col, kinds[0])])
    out = None
    for i in range(count):
        rows = [tuple(r) for r in asked.filter(F.pmod(F.xxhash64("text"), F.lit(count)) == i).collect()]  # a block of about BLOCK characters
        held = _Block(spark.sparkContext.broadcast(rows), uuid.uuid4().hex)

        def run(batches, held=held):
            known = held.value
            for batch in batches:
                at, which = [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    found = {j for _, places in _automaton(held).iter(text) for j in places} if text and known else ()
                    at += [k] * len(found)
                    which += sorted(found)
                kind = pa.int64() if isinstance(kinds[1], T.LongType) else None
                yield pa.RecordBatch.from_arrays([pa.array([known[j][0] for j in which], kind), batch.column(0).take(pa.array(at, pa.int64()))], [key, id_col])

        one = texts.select(id_col, "text").mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out
