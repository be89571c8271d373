"""Suffix buckets of the words that are asked for."""
import pyarrow as pa

from obsweave.llm import brown
from obsweave.llm.common import text_slices


def test_buckets_are_of_the_words_asked_for():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["Running a DOG", "sitting bog running"])], ["doc_id", "text"])
    (t,) = text_slices(iter([batch]))
    ids, buckets, n = brown.hashed(t)
    every = buckets(brown.np.arange(len(ids)))
    assert n.tolist() == [3, 3] and ids[0] == ids[5] and every[0] == every[3] == every[5] != every[1]
    assert buckets(brown.np.array([4, 0])).tolist() == [every[4], every[0]] and len(buckets(brown.np.array([], int))) == 0
