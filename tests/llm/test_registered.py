"""Registered queries against their SQL, and the pipeline."""

import os
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import catalog, decontaminate, langid, pieces, pii, quality, secrets, simhash, similar, substring, tiff, warc
from scriptorium.llm.shared import use_checkpoint_dir
from tests.conftest import DATA, rows_of
from tests.llm.test_decontaminate import by_hand as leaks
from tests.llm.test_models import language_by_hand


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, DATA).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        assert rows_of(got) == rows_of(duck.sql(catalog.ORACLES[name]).df())


def test_pipeline(spark):
    use_checkpoint_dir(spark)
    top = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    had = set(os.listdir(top))
    out = corpus_pipeline.run(spark, DATA).toPandas()
    (folder,) = (x for x in set(os.listdir(top)) - had if x.startswith("pipeline-"))
    assert os.listdir(f"{top}/{folder}") == ["4-tokens"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    assert set(docs.columns) < set(out.columns) and out.lossless.all() and out.doc_id.is_unique
    assert 0.8 * len(docs) < len(out) < len(docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontamination", "personal_data", "tokens"]


def test_stages_take_an_empty_table(spark, empty):
    docs = empty.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        assert after.count() == 0
        docs = after if set(after.columns) == set(docs.columns) else docs


def by_hand(docs, bench, model):
    """The pipeline one row at a time, with all pairs compared; docs: rows of documents."""
    kept = []
    for r in docs:
        lang, score = language_by_hand(model, r.text)
        if lang != "und" and score >= 0.3:
            kept.append(r)
    sets = []
    for r in kept:
        ws = [w for w in re.split(r"[\x20\x09-\x0D]+", (r.text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
        sets.append({tuple(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) > 4 else {tuple(ws)} if ws else set())
    root = list(range(len(kept)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(kept)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * len(sets[i] | sets[j]):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, r in enumerate(kept):
        groups.setdefault(find(i), []).append(r)
    kept = [min(g, key=lambda r: r.doc_id) for g in groups.values()]
    kept = [r for r in kept if not leaks(r.text, bench)[4]]
    out, field = {}, pii.Field(pii.trained())
    for r in kept:
        base, added = pii.find_spans(r.text or "", field)
        runs = []
        for s, e, kind in sorted((s, e, k) for k, s, e in base + added):
            if runs and s < runs[-1][1]:
                runs[-1] = (runs[-1][0], max(e, runs[-1][1]), runs[-1][2] + [kind] * (kind not in runs[-1][2]))
            else:
                runs.append((s, e, [kind]))
        text = r.text
        for s, e, kinds in reversed(runs):
            text = text[:s] + "".join(f"[{k.upper()}]" for k in kinds) + text[e:]
        out[r.doc_id] = text
    return out


def test_pipeline_by_hand(spark):
    docs, bench = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    more = []
    for k, r in enumerate(docs.orderBy("doc_id").limit(30).collect()):
        ws = (r.text or "").split(" ")
        if k % 3 == 0 and len(ws) > 30:
            ws[len(ws) // 2] = "changed"
        more.append((10**6 + k, " ".join(ws) + (" write to jane.roe [at] acme [dot] co [dot] uk" if k % 4 == 0 else ""), r.lang, r.source))
    items = [(r.item_id, r.text) for r in bench.collect()]
    more = [(i, t, None if i % 2 else lang, source) for i, t, lang, source in more]
    more += [(3 * 10**6, "please write to jane.roe [at] acme [dot] co [dot] uk about the cat", "en", "x"), (2 * 10**6, f"we said that {items[0][1]} and more", "en", "x"), (2 * 10**6 + 1, "12 345", "en", "x"), (2 * 10**6 + 2, None, None, None)]
    kinds = dict(docs.dtypes)
    added = spark.createDataFrame(more, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    every = docs.unionByName(added.select(*(F.col(c).cast(kinds[c]) for c in docs.columns)))
    want = by_hand(every.collect(), items, langid.train(every))
    use_checkpoint_dir(spark)
    rows = every
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, rows, DATA)
        if name != "tokens":
            rows = rows.checkpoint()
    got = rows.collect()
    assert {r.doc_id: r.text for r in got} == want and len(got) == len(want) and all(r.lossless and (r.n_chars or 0) == len(r.text or "") for r in got if r.doc_id >= 10**6)
    assert {r.doc_id: r.text for r in pieces.decode(rows).collect()} == want
    model = langid.train(every)
    tongue = {r.doc_id: r.lang or language_by_hand(model, r.text)[0] for r in every.collect() if r.doc_id in want}
    assert {r.doc_id: r.lang for r in got} == tongue
    assert not {2 * 10**6, 2 * 10**6 + 1, 2 * 10**6 + 2} & set(want) and any("[EMAIL]" in t for t in want.values())


def test_text_ids_pass_or_are_refused_at_once(spark):
    """Ids may be text in all operators but one, which says so before any job starts."""
    docs = spark.createDataFrame([("a-1", "the cat and the dog sat on the mat", "en"), ("a-2", None, None), (None, "der hund und die katze", "de"), ("a-2", "the cat and the dog sat on the mat", "en")], "doc_id string, text string, lang string")
    bench = spark.createDataFrame([("b-1", "the cat and the dog")], "item_id string, text string")
    labels = spark.createDataFrame([("a-1", 1), ("a-2", 0)], "doc_id string, quality int")
    count = docs.count()
    found = [
        pieces.encode(docs), pii.find_pii(docs), decontaminate.find_contamination(docs, bench), decontaminate.find_contamination(docs, bench, index_bytes=0), simhash.near_duplicates(docs), langid.classify(docs, langid.train(docs)),
        tiff.image_digests(tiff.read_pages(tiff.write_media(docs))), quality.score(docs, labels), secrets.find_secrets(docs), similar.members(docs),
    ]
    for table in found:
        assert sorted(str(r.doc_id) for r in table.select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.collect())
    kept = similar.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == simhash.one_of_each(docs).count() == count - 1
    archives = warc.write_archives(docs.withColumn("url", F.lit("u")), id_col="doc_id", payload_col="text")
    assert warc.read_archives(archives).where("record_type in ('response', 'revisit')").count() == count
    with pytest.raises(TypeError, match="whole number"):
        substring.removal_digests(docs)
