"""Texts go to Python in batches of some megabytes, however long they are."""

import pyarrow as pa
import pytest

from phasebeat.llm import common, toxicity
from phasebeat.llm.chunks import chunks_of
from phasebeat.llm.simhash import fingerprints


@pytest.fixture
def unset(spark):
    """A session without the limit."""
    spark.conf.unset(common.BATCH_LIMIT)
    yield spark
    spark.conf.unset(common.BATCH_LIMIT)


def test_batches_are_small(unset):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["n", "size"])

    docs = unset.range(300, numPartitions=1).selectExpr("id AS doc_id", "repeat('word ', 20000) AS text")
    found = common.map_texts(docs, sizes, "n long, size long").collect()
    assert sum(r.n for r in found) == 300
    assert max(r.size for r in found) <= common.BATCH_BYTES + 2 * 100_000


@pytest.mark.parametrize(
    "operator", [chunks_of, fingerprints, toxicity.toxicity, toxicity.without_toxic], ids=["chunks", "simhash", "toxicity", "without_toxic"]
)
def test_operators_limit_their_batches(unset, operator):
    docs = unset.createDataFrame([(1, "one two")], "doc_id long, text string")
    more = {"chunks_of": (1 << 20,), "fingerprints": ()}.get(operator.__name__, (None,))
    assert operator(docs, *more).count() == 1
    assert unset.conf.get(common.BATCH_LIMIT) == str(common.BATCH_BYTES)


def test_limit_of_the_caller_is_kept(unset):
    unset.conf.set(common.BATCH_LIMIT, "1000000")
    assert fingerprints(unset.createDataFrame([(1, "one two")], "doc_id long, text string")).count() == 1
    assert unset.conf.get(common.BATCH_LIMIT) == "1000000"
