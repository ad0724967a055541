import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import registry
from scriptorium.operators import text as T
from scriptorium.plans import catalog
from tests.conftest import DATA
from tests.test_text import RANKED, ROUTED


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["lang_rank", "lang_percent_by_doc", "lang_counts_by_doc", "corpus_language_mix", "conversation_language_by_role", "page_language", "mixed_script_distribution", "top_language", "languages_json"])
def test_texts_are_profiled_once_and_by_row(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, DATA))
    assert plan.count("BatchEvalPython") == 1 and "ArrowEvalPython" not in plan


def test_language_mix_of_streams_profiles_once(spark):
    from scriptorium.streaming import live

    rows = spark.createDataFrame([("2026-01-01 00:00:00", "abж"), ("2026-01-01 00:00:01", ""), ("2026-01-01 00:00:02", None)], "at string, text string").withColumn("at", F.to_timestamp("at"))
    mix = live.language_mix(rows, "at")
    assert plan_of(mix).count("EvalPython") == 1
    assert {(r.code, r.letters) for r in mix.collect()} == {("en", 2), ("ru", 1)}


@pytest.mark.parametrize("piece", [1, 3, 1 << 16])
def test_a_text_and_a_batch_give_the_same(monkeypatch, piece):
    monkeypatch.setattr(T, "PIECE", piece)
    r = random.Random(11)
    points = [cp for x in registry.LANGUAGES for lo, hi in x[4] for cp in (lo, hi, (lo + hi) // 2)] + [0, 0x20, 0x30, 0x3000, 0x93F, 0x4E00, 0x1F600, 0x8B5]
    texts = ["".join(chr(r.choice(some)) for _ in range(r.randint(0, 12))) for some in (r.sample(points, r.randint(1, 5)) for _ in range(1500))]
    texts += [None, "", " \t　", "жα", "αж", "αж漢", "a" * 9 + "\x00", *RANKED, *ROUTED]
    want = T._profiles(pa.array(texts, pa.string())).to_pylist()
    assert [T._profile(t) for t in texts] == [tuple(x.values()) for x in want]
    assert len({x["pack_id"] for x in want}) > 10


def test_both_ways_in_spark(spark):
    texts = [*RANKED, *ROUTED, None]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(T.profile("text").alias("a"), T.profile("text", short=True).alias("b"))
    assert all(x.a == x.b for x in rows.collect())


def test_memory_of_a_long_text():
    text = "abcdжα " * 1_000_000
    T.tables()
    tracemalloc.start()
    counts = T._profile(text)[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert counts[:2] == [4_000_000, 1_000_000] and most < 8e6
