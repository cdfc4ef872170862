"""Every stage of the corpus pipeline against brute force on its own input, and the registered queries."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from test_dedup import brute_near, brute_passages
from test_text import brute_leaks, check_packing, library

import __spark_entry__
import corpus_pipeline
from compare import connect, difference
from lossgrid.llm import line_dedup, packing, quality, simhash
from lossgrid.llm.oracles import ORACLES
from lossgrid.llm.queries import QUERIES
from lossgrid.session import ARROW_BYTES, ARROW_CONF

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with awkward rows and columns whose names clash with those inside the operators."""
    df = spark.read.parquet(f"{SF}/documents.parquet")
    first = df.orderBy("doc_id").limit(3)
    rows = [(9000, None, None, None, None), (9001, "", "en", "s", 0), (None, "a text without an id", "en", None, 20)]
    more = spark.createDataFrame(rows, df.schema)
    leak = spark.read.parquet(f"{SF}/benchmark.parquet").limit(1).select("text").first()[0]
    more = more.union(spark.createDataFrame([(9002, "Before.\n" + leak + "\nAfter.", "en", "s", 1)], df.schema))
    clash = {c: F.lit(5) for c in ("score", "row", "lines_removed", "fp", "hash", "_kept", "_found", "start", "length")}
    return df.union(first).union(more).withColumns(clash).repartition(4)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def one_per_group(rows):
    """The row that each group keeps: groups by row number, then the smallest id (null last), then the text's hash."""
    groups = {}
    for n, _, c in brute_near([(n, t) for n, (_, t) in enumerate(rows)]):
        i, t = rows[n]
        h = xxhash.xxh64_intdigest((t or "").encode(), 42) if t is not None else 42
        groups.setdefault(c, []).append((i is None, i or 0, t is not None, h - (1 << 64) if h >> 63 else h, n))
    return [rows[min(members)[-1]] for members in groups.values()]


def leaking_rows(rows, benchmark):
    return {n for n, *_ in brute_leaks([(n, t) for n, (_, t) in enumerate(rows)], benchmark)}


def test_rows_are_judged_by_themselves_whatever_their_ids(spark):
    """Null and repeated ids: a row that leaks takes no other along, and of each group exactly one row stays."""
    item = spark.read.parquet(f"{SF}/benchmark.parquet").select("text").first()[0]
    clean = [f"quite another clean text number {i} with its own words " + " ".join(f"w{i}{j}" for j in range(30)) for i in range(6)]
    rows = [(None, item), (None, clean[0]), (7, item), (7, clean[1]), (8, clean[2]), (8, clean[2]), (5, clean[3])]
    rows += [(None, clean[3]), (None, clean[4]), (None, clean[4]), (7, clean[5])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row_key", F.lit("own"))
    left = corpus_pipeline.decontamination(spark, df, SF)
    assert left.columns == df.columns and rows_of(left, "doc_id", "text") == sorted((r for r in rows if r[1] != item), key=str)
    kept = rows_of(corpus_pipeline.near_duplicates(spark, left, SF), "doc_id", "text")
    want = [(None, clean[0]), (7, clean[1]), (8, clean[2]), (5, clean[3]), (None, clean[4]), (7, clean[5])]
    assert kept == sorted(want, key=str)


def test_stages_against_brute_force(spark, docs):
    columns = docs.columns
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        after = corpus_pipeline.keep(stage(spark, docs, SF), "test")
        if name != "packing":
            assert after.columns == columns and after.schema["doc_id"] == docs.schema["doc_id"], name
            got = rows_of(after, "doc_id", "text")
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            scores = model.scores(pa.array([t or "" for _, t in before]))
            assert got == sorted((r for r, s in zip(before, scores) if s >= 0.5), key=str)
            assert 0.7 < len(got) / len(before) < 0.98
        elif name == "lines":
            want = [r[:2] for r in brute_passages(before)]
            cut = Counter(got)
            assert all(cut[r] == n or not (r[1] or "").strip() for r, n in Counter(want).items())
            assert set(got) <= set(want)
            assert after.where("text is not null and n_chars <> length(text) and doc_id < 9000").count() == 0
        elif name == "near_duplicates":
            assert got == sorted(one_per_group(before), key=str)
        elif name == "decontamination":
            leaked = leaking_rows(before, benchmark)
            assert leaked and got == sorted((r for n, r in enumerate(before) if n not in leaked), key=str)
        else:
            check_packing(after.collect(), before, library(), 1024)
        docs = after


def test_stages_of_an_empty_table(spark, docs):
    docs = docs.where("false")
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.keep(stage(spark, docs, SF), "test")
        assert docs.count() == 0, name


def test_texts_go_to_python_in_bounded_batches_and_once(spark, monkeypatch):
    """What a task holds follows the bound on bytes, not 10 000 rows of any size; no operator sends a text twice."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, f"long text {i} " * 2000, "en", "s", 0) for i in range(600)]  # about 9 MB in one partition
    df = corpus_pipeline.keep(spark.createDataFrame(rows, schema).coalesce(1), "test")
    sent = []
    whole = type(df).mapInArrow

    def map_in_arrow(self, func, *args, **options):
        def sizes(batches):
            return (pa.record_batch({"rows": [b.num_rows], "bytes": [b.nbytes]}) for b in batches)

        sent.append([tuple(r) for r in whole(self, sizes, "rows long, bytes long").collect()])
        return whole(self, func, *args, **options)

    monkeypatch.setattr(type(df), "mapInArrow", map_in_arrow)
    before = spark.conf.get(ARROW_CONF, None)
    spark.conf.unset(ARROW_CONF)
    try:
        quality.score(df, quality.Model(np.zeros(1 << quality.BITS), 1.0))
        line_dedup._edited(df, "doc_id", "text", "n", spark.createDataFrame([], "id long, hash long, chunks array<long>"), line_dedup.without_chunks)
        simhash.fingerprints(df)
        packing.pieces(df)
        assert spark.conf.get(ARROW_CONF) == str(ARROW_BYTES)
        spark.conf.set(ARROW_CONF, "1000000")
        packing.pieces(df)
        assert spark.conf.get(ARROW_CONF) == "1000000"  # the session's own bound stays
    finally:
        spark.conf.unset(ARROW_CONF) if before is None else spark.conf.set(ARROW_CONF, before)
    texts = sum(len(r[1]) for r in rows)
    assert len(sent) == 5
    for batches in sent:
        assert sum(n for n, _ in batches) == 600 and max(b for _, b in batches) <= 1.2 * ARROW_BYTES
        assert texts <= sum(b for _, b in batches) < 1.2 * texts


def test_registered_queries_are_complete():
    numbers = Counter(n.split("_")[0] for n in QUERIES)
    assert numbers == Counter(f"op{n}" for n in range(1, 14))
    assert set(__spark_entry__.queries()) >= {*QUERIES, "pipeline"}
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    assert difference(QUERIES[name](spark, SF), connect(SF), ORACLES[name]) is None
