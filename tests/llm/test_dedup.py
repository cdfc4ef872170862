"""Exact, near, line and suffix dedup against brute force on small and awkward tables."""

import hashlib
import itertools
import random
import re
import uuid

import pytest
import xxhash
from pyspark.sql import functions as F

from lossgrid.llm import common, line_dedup, simhash, suffix_dedup
from lossgrid.llm.exact_dedup import exact_dedup

DOCS = "doc_id long, text string, lang string"


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def awkward(n=60, seed=1):
    """Nulls, empty, blank and long texts, ties, copies, repeated rows and repeated ids."""
    rng = random.Random(seed)
    words = "alpha beta Gamma délta epsilon zeta eta theta iota".split()
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 8, 40])))
        if rng.random() < 0.4 and rows:
            text = rng.choice(rows)[1] or ""
        if rng.random() < 0.3:
            text = text.replace(" ", "\t ", 1) + "\n"
        rows.append((i, text, "en"))
    rows += [(900, None, None), (901, "", None), (902, " \t\n", "de"), (None, "alpha beta", None)]
    rows += [(903, "alpha " * 5000, "en"), (904, "alpha " * 5000, "fr"), (3, "other text of a repeated id", "en")]
    return rows + rows[:5] + [(None, "alpha beta", None)]


# exact dedup


def brute_exact(rows):
    norm = lambda t: re.sub("[\x20\x09-\x0d]", "", t or "")
    out = []
    for i, t, *_ in rows:
        group = [(-len(x or ""), j is None, j) for j, x, *_ in rows if norm(x) == norm(t)]
        best = min(group, key=lambda g: (g[0], g[1], g[2] or 0))
        kept = (i, -len(t or "")) == (best[2], best[0])
        out.append((i, best[2], len(group), kept, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("support", [0.001, 0.08])
def test_exact_dedup_matches_brute_force(spark, support):
    rows = awkward()
    assert rows_of(exact_dedup(table(spark, rows), support=support)) == brute_exact(rows)


def test_exact_dedup_empty_table_and_clashing_columns(spark):
    assert exact_dedup(table(spark, [])).collect() == []
    rows = awkward(20)
    df = table(spark, rows).withColumns({c: F.lit(7) for c in ("keep_id", "text_sha256", "group_size", "best")})
    assert rows_of(exact_dedup(df)) == brute_exact(rows)


# simhash


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(values, distance):
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in itertools.combinations(sorted(root), 2):
        if bin(a ^ b).count("1") <= distance:
            root[find(a)] = find(b)
    return {v: find(v) for v in root}


def brute_near(rows):
    fp = [brute_fingerprint(t) for _, t, *_ in rows]
    root = brute_components(fp, 3)
    out = []
    for (i, *_), f in zip(rows, fp):
        ids = [j for (j, *_), g in zip(rows, fp) if root[g] == root[f] and j is not None]
        out.append((i, f"{f:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def test_near_dedup_matches_brute_force(spark):
    rows = awkward()
    df = table(spark, rows).withColumns({c: F.lit("x") for c in ("fp", "root", "component_id")})
    assert rows_of(simhash.near_dedup(df)) == brute_near(rows)
    assert simhash.near_dedup(table(spark, [])).collect() == []


def test_fingerprint_lowers_ascii_only_and_splits_ascii_space_only():
    for text in ("É A b\x1fc d", "Ünïcode WORDS here now", "one", "one two", "\x0b\x0c x", "K K K"):
        assert simhash.fingerprint(text) == brute_fingerprint(text), text


@pytest.mark.parametrize("block_rows", [4096, 3])
def test_links_equal_all_pairs(spark, monkeypatch, block_rows):
    """A dense cluster, chains of steps of three bits, and noise; with small blocks the finer cut is used."""
    monkeypatch.setattr(simhash, "BLOCK_ROWS", block_rows)
    rng = random.Random(4)
    center = rng.getrandbits(64)
    values = {center} | {center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(120)}
    chain = rng.getrandbits(64)
    for _ in range(12):
        values.add(chain)
        for b in rng.sample(range(64), 3):
            chain ^= 1 << b
    values |= {rng.getrandbits(64) for _ in range(50)} | {0, 7, (1 << 64) - 1}
    as_long = lambda v: v - (1 << 64) if v >> 63 else v
    fps = spark.createDataFrame([(as_long(v),) for v in values], "fp long").repartition(3)
    found = common.components(common.keep(simhash.fingerprint_links(fps), "t"))
    got = {r.node % (1 << 64): r.root % (1 << 64) for r in found.collect()}
    want = brute_components(values, 3)
    groups = lambda roots: {frozenset(v for v in values if roots.get(v, v) == r) for r in set(roots.values()) | values}
    assert {g for g in groups(got) if g} == {g for g in groups(want) if g}


def test_components_of_long_paths_and_hubs(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(5, 5)]
    found = common.components(spark.createDataFrame(edges, "u long, v long"))
    want = {i: 0 for i in range(61)} | {i: 100 for i in range(100, 140)}
    assert {r.node: r.root for r in found.collect()} == want


def test_lookup_splits_frequent_keys_and_keeps_all_rows(spark):
    df = spark.createDataFrame([(k, i) for i, k in enumerate(["hot"] * 50 + list("abc") + [None])], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, v int")
    got = common.lookup(df, small, "k", hot=common.frequent(df, "k", 0.2))
    assert sorted((r.k or "", r.v or 0) for r in got.collect()) == sorted(
        [("hot", 1)] * 50 + [("a", 2), ("b", 0), ("c", 0), ("", 0)]
    )


def test_lookup_evaluates_the_frequent_keys_once(spark, tmp_path):
    """Keys that could differ from one evaluation to the next would lose or double rows."""

    def logged(batches):
        (tmp_path / uuid.uuid4().hex).touch()
        yield from batches

    df = spark.createDataFrame([("hot", i) for i in range(50)] + [("a", 50), ("b", 51)], "k string, i int")
    small = spark.createDataFrame([("hot", 1), ("a", 2)], "k string, v int")
    hot = spark.createDataFrame([("hot",)], "k string").coalesce(1).mapInArrow(logged, "k string")
    reuse = spark.conf.get("spark.sql.exchange.reuse")
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = [tuple(r) for r in common.lookup(df, small, "k", hot=hot).collect()]
    finally:
        spark.conf.set("spark.sql.exchange.reuse", reuse)
    assert len(list(tmp_path.iterdir())) == 1
    assert sorted(got) == sorted([("hot", i, 1) for i in range(50)] + [("a", 50, 2), ("b", 51, None)])


# line dedup


def passage(n, seed):
    rng = random.Random(seed)
    return "\n".join(" ".join(str(rng.randrange(99)) for _ in range(25)) for _ in range(n))


def brute_lines(rows):
    seen, out = set(), {}
    order = {(i is None, i or 0, t or "") for i, t, *_ in rows}
    for no_id, i, t in sorted(order, key=lambda x: (x[0], x[1])):
        kept = []
        for chunk in line_dedup.chunks(t):
            found = line_dedup.body(chunk)
            if found is None or found not in seen:
                kept.append(chunk)
            if found is not None:
                seen.add(found)
        out[None if no_id else i, t] = "".join(kept)
    return sorted(((i, t if t is None else out[i, t]) for i, t, *_ in rows), key=str)


def test_line_dedup_matches_brute_force(spark, monkeypatch):
    shared = passage(12, 1)
    rows = [(i, passage(3, 100 + i) + "\n" + (shared if i % 3 else passage(6, i)) + "\n" + passage(2, 200 + i), "en") for i in range(20)]
    rows += [(50, shared, None), (51, shared + "\n" + shared, None), (52, None, None), (53, "", None), (54, "\n\n\n", "x")]
    rows += [(55, "one line", None), (None, shared, None), (None, shared, None), (50, shared, None), (7, "repeated id\n" + shared, "en")]
    df = table(spark, rows).withColumns({c: F.lit("c") for c in ("hash", "row", "chunks", "edited", "n", "id")})
    for limit in (200_000, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
        got = line_dedup.remove_repeated_lines(df)
        assert got.columns == [*df.columns, "lines_removed"]
        assert rows_of(got.select("doc_id", "text")) == brute_lines(rows)
    assert got.where("lines_removed > 0 and doc_id = 55").count() == 0
    assert line_dedup.remove_repeated_lines(table(spark, [])).collect() == []


def test_equal_digests_with_other_bytes_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "_digest", lambda text: 5)
    rows = [(i, passage(4, i % 3), "en") for i in range(6)]
    pieces = sum(len(line_dedup.chunks(t)) for _, t, _ in rows[:3])
    df = spark.createDataFrame(rows, DOCS)
    gone = line_dedup.repeated_chunks(df).select("id", F.explode("chunks")).collect()
    assert {r.id for r in gone} == {3, 4, 5} and len(gone) == pieces


def test_chunks_put_together_are_the_text_and_resist_shifts():
    for t in ("", "a", "a\n", "\n", "a\nb", passage(50, 3), passage(9, 2) + "\n\n\n", "a\r\nb c\x0bd\ne"):
        assert "".join(line_dedup.chunks(t)) == t
    before, after = set(line_dedup.chunks(passage(60, 5))), set(line_dedup.chunks("new first line\n" + passage(60, 5)))
    assert len(before & after) >= len(before) - 3


def brute_passages(rows):
    """All runs of lines against all runs before them: in an earlier document, or ending earlier in the same one."""
    full = lambda run: sum(1 for line in run if line.strip())
    order = sorted({(i is None, i or 0, t or "") for i, t, *_ in rows}, key=lambda x: (x[0], x[1]))
    seen, out = set(), {}
    for no_id, i, t in order:
        lines, runs, gone = t.split("\n"), [], set()
        for a in range(len(lines)):
            for z in range(a + 1, len(lines)):
                run = tuple(lines[a : z + 1])
                if run[0].strip() and run[-1].strip() and full(run) >= 2 and len("\n".join(run)) >= 64:
                    runs.append((a, z, run))
        own = {}
        for a, z, run in runs:
            if run in seen or own.setdefault(run, z) < a:
                gone.update(range(a, z + 1))
        seen |= {run for *_, run in runs}
        parts = line_dedup.split_lines(t)
        out[None if no_id else i, t] = ("".join(p for j, p in enumerate(parts) if j not in gone), len(gone))
    return sorted(((i, t if t is None else out[i, t][0], out[i, t or ""][1]) for i, t, *_ in rows), key=str)


def test_repeated_passages_of_any_length_go(spark, monkeypatch):
    """Shared passages of 2 to 20 lines between foreign lines, short lines, blank lines, overlapping repeats."""
    rng, rows, kinds = random.Random(6), [], {n: passage(n, n) for n in (2, 3, 4, 6, 8, 20)}
    short = ["a", "bb", "", "ccc " * 5, "d" * 40, " ", "e" * 70]
    for i in range(40):
        parts = [passage(rng.choice([0, 1, 3]), 500 + i), kinds[rng.choice([*kinds])], passage(rng.choice([1, 2]), 700 + i)]
        parts.insert(rng.randrange(4), "\n".join(rng.choice(short) for _ in range(rng.randrange(25))))
        rows.append((i, "\n".join(parts) + rng.choice(["", "\n", "\n\n"]), "en"))
    same = passage(1, 9)
    rows += [(80 + n, "\n".join([same] * n), None) for n in range(1, 6)] + [(90, "x\n" * 200, None), (91, "one line", None)]
    rows += [(92, None, None), (93, "", None), (94, "\n\n", None), (None, kinds[6], None), (None, kinds[6], None), rows[4]]
    df = table(spark, rows)
    for limit in (200_000, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
        got = line_dedup.remove_repeated_passages(df)
        assert rows_of(got.select("doc_id", "text", "lines_removed")) == brute_passages(rows)
    left = "\n".join(t for i, t in {(r.doc_id, r.text or "") for r in got.collect()})
    assert all(left.count(k) == 1 for k in kinds.values())


def test_passages_are_found_by_chunks_first(spark, monkeypatch):
    """Content-defined chunks settle what both places cut alike; only windows outside them are looked at again."""
    shared = passage(40, 3)
    rows = [(i, "\n".join([passage(3, 50 + i), shared, passage(2, 90 + i)]), "en") for i in range(3)]
    calls, real = [], line_dedup.repeated_chunks

    def told(docs, id_column, text_column, bodies_of=line_dedup.chunk_bodies, seeds=None):
        found = real(docs, id_column, text_column, bodies_of, seeds)
        calls.append((bodies_of, sum(len(r.chunks) for r in found.collect())))
        return found

    monkeypatch.setattr(line_dedup, "repeated_chunks", told)
    got = line_dedup.remove_repeated_passages(table(spark, rows))
    assert rows_of(got.select("doc_id", "text", "lines_removed")) == brute_passages(rows)
    (first, seeds), (second, rest) = calls
    assert (first, second) == (line_dedup.chunk_bodies, line_dedup.window_bodies) and seeds > 0
    every = real(table(spark, rows), "doc_id", "text", line_dedup.window_bodies)
    assert rest < sum(len(r.chunks) for r in every.collect()) / 2


# suffix dedup


def brute_suffix(rows, depth):
    first = {}
    for i, t, *_ in rows:
        b, k = (t or "").encode(), float("inf") if i is None else i
        for p in range(len(b) - depth + 1):
            first[b[p : p + depth]] = min(k, first.get(b[p : p + depth], k))
    out = []
    for i, t, *_ in rows:
        b, k = (t or "").encode(), float("inf") if i is None else i
        gone = bytearray(len(b))
        for p in range(len(b) - depth + 1):
            if first[b[p : p + depth]] < k:
                gone[p : p + depth] = b"\1" * depth
        spans = sum(1 for j in range(len(b)) if gone[j] and (j == 0 or not gone[j - 1]))
        left = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def overlapping(n=50, seed=2):
    rng = random.Random(seed)
    base = "".join(rng.choice("abc déf\n") for _ in range(2500))
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randrange(6)):
            a = rng.randrange(2400)
            shared = rng.random() < 0.7
            parts.append(base[a : a + rng.randrange(20, 200)] if shared else "".join(rng.choice("xyz ") for _ in range(90)))
        rows.append((i if rng.random() < 0.9 else rng.choice([None, 3, 7]), "".join(parts), "en"))
    rows += [(100, None, None), (101, "", None), (102, "a" * 49, None), (103, "a" * 50, None), (104, "a" * 500, None)]
    return rows + [(2, "a" * 300, None), (105, base, None), (105, base, None), (None, base, None)]


@pytest.mark.parametrize(
    "options", [{"batch_bytes": 700}, {"batch_bytes": 1 << 20}, {"batch_bytes": 2000, "digit": 5}, {"depth": 20, "digit": 8}]
)
def test_suffix_dedup_matches_brute_force(spark, options):
    rows = overlapping()
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("batch", "ids", "body", "n_bytes")})
    assert rows_of(suffix_dedup.remove_repeats(df, **options)) == brute_suffix(rows, options.get("depth", 50))


@pytest.mark.parametrize("hot_batches", [2, 6])
def test_suffix_dedup_small_blocks_many_buckets(spark, monkeypatch, hot_batches):
    rows = overlapping(30, 9)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 100)
    monkeypatch.setattr(suffix_dedup, "HOT_BATCHES", hot_batches)
    monkeypatch.setattr(suffix_dedup, "MOST_HOT", 40)
    monkeypatch.setattr(suffix_dedup, "BUCKET_DIGITS", 20)
    assert rows_of(suffix_dedup.remove_repeats(table(spark, rows), batch_bytes=900)) == brute_suffix(rows, 50)


def test_suffix_dedup_empty_table_and_kept_text(spark):
    assert suffix_dedup.remove_repeats(table(spark, [])).collect() == []
    shared = "x" * 10 + "".join(map(str, range(60)))
    got = suffix_dedup.remove_repeats(table(spark, [(1, shared, None), (2, "left " + shared + " right", None)]), with_text=True)
    assert {r.doc_id: bytes(r.kept) for r in got.collect()} == {1: shared.encode(), 2: b"left  right"}


def test_a_common_line_between_different_neighbours_does_not_fill_a_group(spark, monkeypatch):
    """A line of 40 bytes in every document: all its runs differ, share their leading digit, and skip the second pass."""
    line, rng = "this very line stands in all documents. ", random.Random(3)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(3, 9)))
    rows = [(i, " ".join(word() for _ in range(30)) + line + " ".join(word() for _ in range(30)), "en") for i in range(200)]
    rows += [(500 + i, rows[i][1][:200] + word(), "en") for i in range(0, 60, 3)]
    monkeypatch.setattr(suffix_dedup, "LEAD_DIGITS", 50)
    asked, found = [], []
    monkeypatch.setattr(suffix_dedup, "full_leads", lambda c, s, f=suffix_dedup.full_leads: found.append(f(c, s)) or found[-1])

    def answer(sent, leading, real=suffix_dedup.answer):
        sizes = sent.select("bucket", (F.octet_length("digits") / 8).alias("n")).groupBy("bucket").agg(F.sum("n").alias("n"))
        asked.append((leading, max(r["n"] for r in sizes.collect())))
        return real(sent, leading)

    monkeypatch.setattr(suffix_dedup, "answer", answer)
    monkeypatch.setattr(suffix_dedup, "BUCKET_DIGITS", 20)
    want = brute_suffix(rows, 50)
    assert rows_of(suffix_dedup.remove_repeats(table(spark, rows), batch_bytes=900)) == want
    assert len(found[0]) > 0 and asked[0][0]
    without = list(asked)
    asked.clear()
    monkeypatch.setattr(suffix_dedup, "LEAD_DIGITS", 10**9)
    assert rows_of(suffix_dedup.remove_repeats(table(spark, rows), batch_bytes=900)) == want
    assert len(found[1]) == 0 and without[0][1] < 100 < asked[0][1]


def test_suffix_buckets_stay_within_sparks_limit_and_leave_no_table(spark):
    assert suffix_dedup.store_buckets(0) == 1 and suffix_dedup.store_buckets(17 << 20) == 2
    assert suffix_dedup.store_buckets(100 << 40) == suffix_dedup.store_buckets(100_001 * (16 << 20)) < 100_000
    before = {t.name for t in spark.catalog.listTables()}
    suffix_dedup.remove_repeats(table(spark, [(1, "x" * 100, None), (2, "y" + "x" * 100, None)])).collect()
    assert {t.name for t in spark.catalog.listTables()} == before
