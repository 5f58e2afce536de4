"""Packed ids in binary files."""

import os

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from crosstally.llm import packing
from crosstally.llm.common import table

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens(spark):
    docs = table(spark, SF, "documents")
    odd = spark.createDataFrame([(None, "a null id"), (7, ""), (8, None), (9, "twice"), (9, "twice")], "doc_id long, text string")
    docs = docs.select("doc_id", "text").union(odd).withColumn("shard", F.lit("x"))
    return packing.token_ids(docs.repartition(3, "doc_id"), RANKS, public_tokenizers.PATTERN).cache()


def test_files_hold_what_was_packed(spark, tokens, tmp_path):
    folder = str(tmp_path / "packed")
    manifest = packing.write(tokens, 50256, folder, length=256, shard_tokens=20_000).collect()
    want = packing.packed(tokens, 50256, length=256, shard_tokens=20_000)
    order = ["shard", "shard_run", "row"]
    got = packing.read(spark, folder)
    assert got.columns == want.columns
    assert got.orderBy(*order).collect() == want.orderBy(*order).collect()
    names = sorted(f for f in os.listdir(folder) if f != "manifest")
    assert names == sorted(f.rsplit("/", 1)[1] for m in manifest for f in m.files) and len(manifest) > 3
    one = manifest[0]
    ids = np.fromfile(one.files[0], "<u4").reshape(one.rows, 256)
    ends = np.fromfile(one.files[1], "<i4")
    assert (ids != 50256).sum() == one.n_tokens and len(ends) == sum(one.segments) + one.rows


def test_a_repeated_task_leaves_the_same_files(spark, tokens, tmp_path):
    """Tasks that fail after they wrote are run again."""
    folder, mark = str(tmp_path / "packed"), str(tmp_path / "failed")
    first = packing.write(tokens, 50256, folder, length=256).collect()
    # A second job over the same tokens stands for the second attempt of every task.
    spark._jvm.org.apache.hadoop.fs.FileSystem.getLocal(spark._jsc.hadoopConfiguration()).rename(
        spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest"), spark._jvm.org.apache.hadoop.fs.Path(mark)
    )
    second = packing.write(tokens, 50256, folder, length=256).collect()
    assert sorted(map(repr, first)) == sorted(map(repr, second))
    assert len(os.listdir(folder)) == 4 * len(first) + 1
    assert packing.read(spark, folder).count() == sum(m.rows for m in first)


def test_no_tokens_no_files(spark, tokens, tmp_path):
    folder = str(tmp_path / "packed")
    assert packing.write(tokens.limit(0), 50256, folder).collect() == []
    assert packing.read(spark, folder).collect() == [] and os.listdir(folder) == ["manifest"]
