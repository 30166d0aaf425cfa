"""Shape of the plans of the text operators."""

import re

import pytest
from odd_rows import none, odd, shared  # noqa: F401
from pyspark.sql import functions as F

from growthgrain.llm import chats, mixing, substrings, syncmers

SAMPLE = "/root/testdata/sf0.001"
PYTHON = re.compile("Python|Pandas|InArrow")


def plan_of(df, run=False):
    if run:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_native_operators_run_no_python(no_broadcast):
    docs = no_broadcast.read.parquet(f"{SAMPLE}/documents.parquet")
    turns = no_broadcast.read.parquet(f"{SAMPLE}/conversations.parquet")
    for df in (syncmers.edited_pairs(docs), mixing.mix(docs, ["doc_id"]), chats.collapse(turns)):
        plan = plan_of(df)
        assert not PYTHON.search(plan)
        for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
            assert node not in plan


def test_texts_pass_one_exchange(no_broadcast, odd):
    edits = plan_of(syncmers.edited_pairs(odd))
    assert len(re.findall(r"Exchange hashpartitioning\(range", edits)) == 1
    plan = plan_of(substrings.repeats(odd), run=True).split("== Initial Plan ==")[0]
    with_text = [line for line in plan.split("\n") if "Exchange hashpartitioning(chunk" in line]
    texts = [line for line in with_text if "ReusedExchange" not in line]
    assert any("ReusedExchange [chunk" in line for line in plan.split("\n")) and texts


def test_turns_pass_one_exchange(no_broadcast):
    turns = no_broadcast.read.parquet(f"{SAMPLE}/conversations.parquet")
    plan = plan_of(chats.collapse(turns), run=True).split("== Initial Plan ==")[0]
    moved = [line for line in plan.split("\n") if "Exchange hashpartitioning(_conversation" in line]
    first = [line for line in moved if "ReusedExchange" not in line]
    assert len(first) == 2 and len(moved) - len(first) == 2  # the turns, and which ones stay
