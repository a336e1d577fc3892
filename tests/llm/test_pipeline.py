"""The pipeline stage by stage against brute force on the smallest test tables."""

import os
import sys

import pyarrow as pa
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from llm_data import components, kept_words  # noqa: E402
from test_pairs_and_passages import leaks_of  # noqa: E402
from test_tokens_and_packing import WHOLE, check_packing, crc  # noqa: E402

import corpus_pipeline  # noqa: E402
from seriesloom import storage  # noqa: E402
from seriesloom.llm import decontamination, encoding, ngram_join, packing, substrings, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_and_run_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    rejected = {r.doc_id for r in toxicity.toxicity_scores(docs, labels).where("predicted = 1").collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]

    left = {i: r for i, r in rows.items() if i not in rejected}
    groups = components([(i, r["text"]) for i, r in left.items()])
    left = {i: r for i, r in left.items() if groups[i][1] == i}
    kept = kept_words([(i, r["text"]) for i, r in left.items()])
    for i, r in left.items():
        if len(kept[i]) < len(r["text"].split()):
            text = b" ".join(kept[i]).decode()
            left[i] = {**r, "text": text, "n_chars": len(text)}
    cut = {i: dict(r) for i, r in left.items()}
    leaks = {i for i, _ in leaks_of([(i, r["text"]) for i, r in left.items()], items)}
    left = {i: r for i, r in left.items() if i not in leaks}

    after_cut = docs.where(~docs.doc_id.isin(list(rejected)))
    after_cut = stages["substring dedup"](spark, stages["n-gram Jaccard join"](spark, after_cut, SF), SF)
    assert after_cut.columns == COLUMNS
    assert {r.doc_id: r.asDict() for r in after_cut.collect()} == cut

    pieces = corpus_pipeline.run(spark, SF).collect()
    check_packing(pieces, 4096)
    ids = {i: WHOLE.encode(r["text"], add_special_tokens=False).ids + [1] for i, r in left.items()}
    assert {p.doc_id for p in pieces} == set(ids)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))
    for p in pieces:
        assert crc(ids[p.doc_id][p.start:p.start + p.length]) == p.ids_crc32


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).collect() == []


def test_stages_keep_columns_named_like_helpers(spark):
    names = ("gone rejected leak digest part rank local of_part of_length shift id hash rep copy starts ends c0 c1 block window "
             "toxic fold score predicted __gone __rejected __id __hash __part __rank sequence_id offset").split()
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60)
    for i, name in enumerate(names):
        docs = docs.withColumn(name, docs.doc_id * 100 + i)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF)
        assert kept.columns == docs.columns
        rows = kept.collect()
        assert rows and all(r[name] == r.doc_id * 100 + i for r in rows for i, name in enumerate(names))
    pieces = spark.createDataFrame([(i, 1 + i % 7, i, i, i, i) for i in range(50)],
                                   "__part long, length long, part long, rank long, offset long, __rank long")
    placed = packing.pack_pieces(pieces, 7)
    assert placed.columns == ["__part", "length", "part", "rank", "__rank", "sequence_id", "offset"]
    placed = placed.collect()
    assert sorted(r.part for r in placed) == list(range(50))
    assert all(r["__part"] == r.part == r["rank"] == r["__rank"] and r.length == 1 + r.part % 7 for r in placed)


def test_stages_feed_their_tasks_bounded_batches(spark, monkeypatch):
    """Long texts go to Python about 2 MB at a time; narrow rows, and settings afterwards, are as ever."""
    def sizes(batches):
        for batch in batches:
            yield pa.record_batch([pa.array([len(batch)] * len(batch), pa.int64())], names=["n"])

    def measured(docs, *others):
        assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 500
        found = docs.mapInArrow(sizes, "n long")
        return found if lazy else storage.written_table(found)

    for module, name in ((toxicity, "without_toxic"), (ngram_join, "one_per_group"), (substrings, "without_repeats"),
                         (decontamination, "decontaminated")):
        monkeypatch.setattr(module, name, measured)
    keys = (*storage._BATCH_ROWS, storage._BATCH_BYTES)
    before = [spark.conf.get(key, None) for key in keys]
    ids = spark.range(0, 3000, 1, 1)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        lazy = name == "substring dedup"  # whose last step passes the texts through Python
        rows = [r.n for r in stage(spark, ids.withColumn("text", F.repeat(F.lit("word "), 2000)), SF).collect()]
        assert len(rows) == 3000 and max(rows) * 10_000 <= 2_100_000
        assert {r.n for r in stage(spark, ids, SF).collect()} == {3000}
    assert [spark.conf.get(key, None) for key in keys] == before


def test_word_ids_of_packing_go_when_toxicity_counts():
    encoder = encoding.encoder(encoding.default_tokenizer())
    assert len(encoder.ids("some words")) > 2 and encoding.encoder(encoding.default_tokenizer()) is encoder

    class Tasks:
        def mapInArrow(self, count, schema):
            list(count([]))
            return self

        def groupBy(self, *_):
            return self

        def agg(self, *_):
            return self

    toxicity.gram_counts(Tasks())
    assert encoding.encoder(encoding.default_tokenizer()) is not encoder
