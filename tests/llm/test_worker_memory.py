"""What a worker holds: a batch of rows of bounded bytes, and one stage's model at a time."""

import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from barloom.llm import byte_bpe, common, decontam, toxicity


def test_batches_are_bounded_in_bytes(spark):
    common.ship(spark)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    rows = spark.range(200, numPartitions=1).select(F.repeat(F.lit("words "), 17_000).alias("text"))
    got = rows.mapInArrow(run, "n long, size long").collect()
    assert sum(r.n for r in got) == 200
    assert max(r.size for r in got) < common.BATCH_BYTES + 200_000


def test_a_worker_keeps_one_model():
    class Held:
        value = ("digest", [(1, "a passage of the benchmark")])

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    model = byte_bpe.model_of(ranks, public_tokenizers.PATTERN)
    assert byte_bpe.model_of(ranks, public_tokenizers.PATTERN) is model and list(common._kept.values()) == [model]
    matcher = decontam._matcher(Held, 0.8)
    assert decontam._matcher(Held, 0.8) is matcher and list(common._kept.values()) == [matcher]
    list(toxicity._counts(iter([])))
    assert not common._kept
