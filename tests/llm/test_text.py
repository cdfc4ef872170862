"""Tokens, packing, token counts, decontamination, classifier, languages and archives."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lossgrid.llm import common, decontaminate, language, packing, quality, token_counts, tokens, warc

DOCS = "doc_id long, text string, lang string"
SF = "/root/testdata/sf0.001"


@lru_cache
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture
def plain():
    return library()


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def table(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3)


def awkward():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "of", "naïve", "x1", "\n", "and"]) for _ in range(rng.choice([0, 1, 5, 700, 3000]))), "en") for i in range(40)]
    rows += [(90, None, None), (91, "", None), (92, " \n\t ", None), (None, "no id", "en"), (93, "漢字 🙂 text", "zh")]
    return rows + [(5, "other text", "en"), *rows[:3], *rows[:3], (94, "word " * 20_000, "en")]


# tokens

PIECES = [" ", "  ", "\n", " \n", "\t", "a", "The", "é", "ß", "1", "23", "'s", "'", " 'll", "…", "漢", "　", "\xa0", "\x85"]
PIECES += ["\x0b", "\x1c", "<|endoftext|>", "<|", "!!", "###", "🙂", "ʰ", "​", "İ", ".\n"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map("".join), max_size=6))
def test_ids_equal_the_tokenizers_library(texts):
    plain, coder = library(), tokens.encoder()
    flat, at = coder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = flat[at[i] : at[i + 1]].tolist()
        assert own == ids_of(plain, t)
        assert coder.widths[own].sum() == len(t.encode())


def test_passes_cover_all_rows():
    texts = pa.array(["x" * n for n in (0, 5, 100, 0, 3, 3)])
    assert tokens.passes(texts, 8) == [(0, 2), (2, 3), (3, 6)]
    assert tokens.passes(pa.array([], pa.string()), 8) == []


# packing


def check_packing(got, rows, plain, capacity):
    want = Counter()
    whole = {}
    for i, t, *_ in rows:
        ids = [*ids_of(plain, t), 0]
        want[i, len(ids)] += len(ids)
        whole.setdefault((i, len(ids)), []).append(ids)
    have, sequences = Counter(), defaultdict(list)
    for r in got:
        have[r["doc_id"], r["doc_tokens"]] += r["length"]
        crcs = {zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for x in whole[r["doc_id"], r["doc_tokens"]]}
        assert r["ids_crc32"] in crcs and 0 < r["length"] <= capacity
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    pad = 0
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
        pad += 0 if end & (end - 1) == 0 else capacity - end
    assert sorted(sequences) == list(range(len(sequences)))
    return pad


@pytest.mark.parametrize("bucket_rows", [100_000, 4])
def test_packing_places_every_id_once(spark, plain, monkeypatch, bucket_rows):
    rows = awkward()
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("start", "length", "bucket", "rank")})
    parts = common.keep(packing.pieces(df, capacity=256), "t")
    pad = check_packing(packing.pack(parts, 256, bucket_rows).collect(), rows, plain, 256)
    # not more padding than first fit in decreasing order
    bins = []
    for r in sorted(parts.collect(), key=lambda r: -r["length"]):
        at = next((i for i, b in enumerate(bins) if b + r["length"] <= 256), None)
        if at is None:
            bins.append(r["length"])
        else:
            bins[at] += r["length"]
    assert pad <= sum(0 if b & (b - 1) == 0 else 256 - b for b in bins)
    assert packing.pack_documents(table(spark, [])).collect() == []


def test_pieces_carry_their_ids(spark, plain):
    rows = [(1, "some words here", None), (2, None, None)]
    got = {r.doc_id: r.ids for r in packing.pieces(table(spark, rows), with_ids=True).collect()}
    assert got == {1: [*ids_of(plain, rows[0][1]), 0], 2: [0]}


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_uses_every_piece_once_and_fills_from_zero(histogram):
    rows = packing.plan(histogram, 64)
    taken, windows = defaultdict(list), defaultdict(list)
    for length, lo, hi, uses, first, base in rows:
        taken[length].append((lo, hi))
        for rank in range(lo, hi):
            k = rank - lo
            windows[first + k // uses].append((base + k % uses * length, length))
    for length, n in histogram.items():
        assert [x for lo, hi in sorted(taken[length]) for x in range(lo, hi)] == list(range(n))
    for parts in windows.values():
        parts.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:])) and parts[0][0] == 0
        assert sum(n for _, n in parts) <= 64
    assert sorted(windows) == list(range(len(windows)))


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 3), min_size=1, max_size=6))
def test_window_has_the_least_padding_of_all_choices(counts):
    capacity, longest = 20, max(counts)
    sums = {longest}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n - (length == longest) + 1)}
    pad = lambda s: 0 if s & (s - 1) == 0 or s == capacity else capacity - s
    used = packing.fill(counts, capacity)
    assert all(k <= counts[n] for n, k in used.items())
    assert pad(sum(n * k for n, k in used.items())) == min(pad(s) for s in sums if s <= capacity)


# token counts


def brute_sections(plain, parts):
    """Spans by decoding prefixes: byte lengths of the ids from the vocabulary's own byte table."""
    text = "".join(parts).encode()
    ids, coder = ids_of(plain, "".join(parts)), tokens.encoder()
    edges, at = [0], 0
    for p in parts:
        at += len(p.encode())
        edges.append(at)
    counts, crossing, pos = [0] * len(parts), [0] * len(parts), 0
    for i in ids:
        end = pos + int(coder.widths[i])
        shares = [max(0, min(end, edges[s + 1]) - max(pos, edges[s])) for s in range(len(parts))]
        best = shares.index(max(shares))
        counts[best] += 1
        crossing[best] += sum(x > 0 for x in shares) > 1
        pos = end
    assert pos == len(text)
    return [(s, edges[s], edges[s + 1], counts[s], crossing[s]) for s in range(len(parts))]


def test_line_tokens_match_brute_force(spark, plain):
    rows = awkward()[:45] + [(200, "a\n\n\nb\n", None), (201, "\n", None), (202, "x" + "\n" * 9, None), (203, "漢\n漢", None)]
    got = defaultdict(list)
    df = table(spark, rows).withColumns({c: F.lit(1) for c in ("section", "parts", "tokens")})
    for r in token_counts.section_tokens(df, token_counts.lines()).collect():
        got[r.doc_id].append((r.section, r.start, r.end, r.tokens, r.crossing))
    want = defaultdict(list)
    for i, t, _ in rows:
        parts = re.split(r"(?<=\n)", t or "")
        want[i] += brute_sections(plain, [p for p in parts if p] or [""])
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert token_counts.section_tokens(table(spark, []), token_counts.lines()).collect() == []


def test_fields_split_one_document(spark, plain):
    rows = [(1, "a title", "the body\n\nof it"), (2, None, "only a body"), (3, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string")
    got = defaultdict(list)
    for r in token_counts.section_tokens(df, token_counts.fields("title", "body")).orderBy("section").collect():
        got[r.doc_id].append((r.section, r.start, r.end, r.tokens, r.crossing))
    for i, a, b in rows:
        assert got[i] == brute_sections(plain, [(a or "") + "\n", b or ""])


def test_a_row_without_sections_gives_none(spark):
    df = spark.createDataFrame([(1, None), (2, []), (3, [None, "x"])], "doc_id long, p array<string>")
    got = token_counts.section_tokens(df, F.col("p")).collect()
    assert sorted((r.doc_id, r.section, r.tokens) for r in got) == [(3, 0, 0), (3, 1, 1)]


def test_boundary_rule():
    # bytes 0-4 | 4-6 | 6-6 | 6-9: most bytes win, a tie goes to the first
    bounds = np.array([0, 4, 6, 6, 9])
    section, crossing = token_counts.attribute(np.array([0, 3, 5, 8]), np.array([3, 5, 8, 9]), bounds)
    assert section.tolist() == [0, 0, 3, 3] and crossing.tolist() == [1, 2]


# decontamination


def brute_leaks(docs, items, threshold=0.8):
    split = lambda text: [w for w in re.split(r"[^\w]|_", (text or "").lower()) if w]
    runs = lambda words, k: {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}
    want = defaultdict(set)
    for i, t in items:
        words = split(t)
        want[i] |= runs(words, min(5, len(words))) if words else set()
    out = set()
    for d, t, *_ in docs:
        words = split(t)
        have = {k: runs(words, k) for k in range(1, 6)}
        for i, own in want.items():
            n = sum(x in have[len(x)] for x in own)
            if own and n >= threshold * len(own) - 1e-9:
                out.add((d, i, n, len(own)))
    best = {}
    for d, i, k, n in out:
        best[d, i] = max(best.get((d, i), (0, n)), (k, n))
    return sorted(((d, i, k, n, k / n) for (d, i), (k, n) in best.items()), key=str)


@pytest.mark.parametrize("broadcast", [True, False])
def test_contained_items_match_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", -1)
    rng = random.Random(8)
    word = lambda: rng.choice("red blue green one two three four five six".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([1, 3, 5, 12, 40])))) for i in range(12)]
    items += [(20, None), (21, " ,, "), (22, "two, words"), (22, "and a longer text under the same id"), (3, "an item with the same id as another one"), (None, "item without an id but with words")]
    docs = []
    for d in range(40):
        noise = [word() for _ in range(rng.choice([0, 3, 60, 600]))]
        item = (rng.choice(items)[1] or "").split()
        for k in rng.sample(range(len(item)), min(len(item) // 14, len(item))):
            item[k] = "changed"
        at = rng.randrange(len(noise) + 1)
        docs.append((d, ", ".join(noise[:at] + [w.upper() for w in item] + noise[at:]), "en"))
    docs += [(100, None, None), (101, "", None), (None, items[-1][1] + " more", None), *docs[:4], (1, items[3][1] + " x y z", "en")]
    docs += [(102, "she said: Two words! and left", "en"), (103, "two other words", "en"), (104, "two words", "en")]
    df = table(spark, docs).withColumns({c: F.lit(1) for c in ("item_id", "hash", "items", "s", "d", "needed")})
    got = decontaminate.contained_items(df, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == brute_leaks(docs, items)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(df, none).collect() == []
    assert decontaminate.contained_items(table(spark, []), none).collect() == []


# quality


def test_scores_equal_the_mean_of_all_features():
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << quality.BITS), 0.3)
    texts = pa.array(["", "one", "two words", "a a a b", " edge  spaces\n", "naïve ### !!", "x " * 500])
    cells, shares, bounds = quality.features(texts)
    means = [float((model.gain[cells[a:z]] * shares[a:z]).sum()) for a, z in zip(bounds, bounds[1:])]
    assert np.allclose(model.scores(texts), 1 / (1 + np.exp(-(np.array(means) + 0.3))))


def test_training_equals_the_same_descent_written_word_by_word(monkeypatch):
    for name, value in (("EPOCHS", 2), ("LEAST_STEPS", 5), ("BATCH", 3)):
        monkeypatch.setattr(quality, name, value)
    texts = ["good text here", "bad bad text", "", "good words", "some bad words here", "good good", "x"]
    labels = [1, 0, 1, 1, 0, 1, 0]
    model = quality.train(texts, labels, seed=5)
    cells, shares, bounds = quality.features(pa.array(texts))
    docs = [list(zip(cells[a:z].tolist(), shares[a:z].tolist())) for a, z in zip(bounds, bounds[1:])]
    rng, k = np.random.default_rng(5), quality.DIMENSIONS
    vectors = rng.uniform(-1 / k, 1 / k, (1 << quality.BITS, k)).astype(np.float32).astype(float)
    output, bias, step = [[0.0] * k, [0.0] * k], [0.0, 0.0], 0
    epochs = max(2, -(-5 * 3 // len(texts)))
    steps = epochs * -(-len(texts) // 3)
    for _ in range(epochs):
        order = rng.permutation(len(texts)).tolist()
        for first in range(0, len(order), 3):
            rate, batch = quality.RATE * (1 - step / steps), order[first : first + 3]
            step += 1
            moves, out_move, bias_move = [], [[0.0] * k, [0.0] * k], [0.0, 0.0]
            for d in batch:
                hidden = [sum(vectors[c][i] * w for c, w in docs[d]) for i in range(k)]
                logits = [sum(h * o for h, o in zip(hidden, output[j])) + bias[j] for j in (0, 1)]
                chance = 1 / (1 + np.exp(logits[0] - logits[1]))
                error = [1 - chance - (labels[d] == 0), chance - (labels[d] == 1)]
                for j in (0, 1):
                    bias_move[j] += error[j] / len(batch)
                    for i in range(k):
                        out_move[j][i] += error[j] * hidden[i]
                back = [error[0] * output[0][i] + error[1] * output[1][i] for i in range(k)]
                moves += [(c, [quality.SCALE * b * w for b in back]) for c, w in docs[d]]
            for c, move in moves:
                vectors[c] -= rate * np.array(move)
            for j in (0, 1):
                bias[j] -= rate * bias_move[j]
                output[j] = [o - rate * m for o, m in zip(output[j], out_move[j])]
    gain = vectors @ (np.array(output[1]) - np.array(output[0]))
    used = np.unique(cells)
    assert np.allclose(model.gain[used], gain[used], rtol=2e-3, atol=1e-5) and np.abs(gain[used]).max() > 1e-3
    assert np.isclose(model.bias, bias[1] - bias[0], rtol=1e-3, atol=1e-5)


def test_classifier_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    df = docs.withColumns({c: F.lit(1) for c in ("score", "row", "predicted", "label", "quality")})
    got = quality.classify(df, labels).collect()
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 50


def test_classifier_edge_cases(spark):
    labels = spark.createDataFrame([(1, None, 0), (None, 1, 0), (2, 5, 0)], "doc_id long, quality int, toxic int")
    rows = [(1, None, None), (2, "", None), (None, "text", "en"), (2, "", None), (3, "w " * 100_000, "en")]
    got = quality.classify(table(spark, rows), labels).collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "2", "2", "3", "None"] and {r.score for r in got} == {0.5}
    assert quality.classify(table(spark, []), labels).collect() == []
    one = quality.train(["a", "b"], [0, 0])
    assert one.scores(pa.array(["a"]))[0] < 0.5


# languages


def brute_language(model, text):
    """The documented estimate for one text, word by word."""
    words = [w for w in re.split(r"[\W\d_]+", text.lower()) if w]
    if not words:
        return "und", 0.0
    logs = []
    for w in words:
        owner, grams = language.ngrams(pa.array([w]), *language.NGRAMS)
        logs.append(model.logs[language.bucket(grams, language.BITS)].astype(float).sum(axis=0))
    logs = np.array(logs)
    scaled = np.exp(logs - logs.max(axis=1, keepdims=True))

    def maximise(share):
        for _ in range(language.ROUNDS):
            part = scaled * share
            share = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        return share, np.log((scaled * share).sum(axis=1)).sum()

    n = len(model.languages)
    share, _ = maximise(np.full(n, 1 / n))
    order, found = np.argsort(-share, kind="stable"), []
    for k in range(1, n + 1):
        part = np.zeros(n)
        part[order[:k]] = np.maximum(share[order[:k]], 1e-6)
        part, fit = (share, maximise(np.full(n, 1 / n))[1]) if k == n else maximise(part / part.sum())
        found.append((fit - language.PENALTY * (k - 1) * np.log(len(words) + 1) / 2, part))
    best = max(found, key=lambda x: x[0])[1]
    return model.languages[int(best.argmax())], float(best.max())


def test_language_mixture_matches_a_plain_estimate(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    model = language.train([r.text for r in docs], [r.lang for r in docs])
    texts = [r.text for r in docs[:25]] + ["", "123 ###", "É", "The\nund", docs[0].text + " " + docs[1].text]
    names, values = model.predict(pa.array(texts))
    for t, name, value in zip(texts, names, values):
        want = brute_language(model, t)
        assert name == want[0] and abs(value - want[1]) < 1e-6


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r for r in language.identify(docs.withColumn("score", F.lit(1))).collect()}
    held = [r for r in docs.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in held) >= 0.97 * len(held) > 200


def test_language_edge_cases(spark):
    rows = [(1, "the of and", "en"), (2, "der die das", "de"), (3, None, None), (4, "", "en"), (5, "12 ##", "de")]
    rows += [(None, "the of and the", "xx"), (1, "the of and", "en"), (6, "the and of " * 30_000, None)]
    got = language.identify(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and (r.lang_pred == "und") == (r.doc_id in (3, 4, 5))
    assert {r.lang_pred for r in got} <= {"en", "de", "und"}
    assert language.identify(table(spark, [])).collect() == []
    unlabelled = language.identify(table(spark, [(1, "text", None)])).collect()
    assert [(r.lang_pred, r.score) for r in unlabelled] == [("und", 0.0)]


# archives

PAGES = "page_id long, url string, html string"


def brute_pages(rows, least=0):
    out = []
    for i, _, html, *_ in rows:
        data = (html or "").encode()
        same = [j for j, _, h, *_ in rows if (h or "") == (html or "") and j is not None]
        top = max(same, default=None)
        revisit = len(data) >= least and top is not None and top != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,broadcast", [(0, 10_000), (6, -1)])
def test_archives_round_trip(spark, monkeypatch, tmp_path, least, broadcast):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", broadcast)
    rows = [(i, f"http://x/{i}", ["", "same page", "é" * 9, f"own {i}", "line\r\n\r\nWARC/1.1\r\n"][i % 5]) for i in range(40)]
    rows += [(100, None, None), (None, "http://n\r\nX: y", "no id"), (None, None, "same page"), rows[3], rows[1], (101, "u", "x" * 400_000)]
    df = table(spark, rows, PAGES).withColumns({c: F.lit(1) for c in ("payload", "digest", "first", "path")})
    got = warc.round_trip(df, f"file://{tmp_path}/a", least_bytes=least, archive_bytes=2000)
    assert sorted(map(tuple, got.collect()), key=str) == brute_pages(rows, least)
    assert len(list((tmp_path / "a").iterdir())) > 3
    assert warc.round_trip(table(spark, [], PAGES)).collect() == []


@pytest.mark.parametrize("harm", ["missing", "cut", "flipped"])
def test_a_missing_or_damaged_archive_is_not_passed_over(spark, tmp_path, harm):
    rows = [(i, f"http://x/{i}", f"page {i} " * 20) for i in range(40)]
    manifest = warc.write_archives(table(spark, rows, PAGES), f"file://{tmp_path}/a", archive_bytes=2000)
    kept, gaps = warc.verified_records(manifest)
    assert kept.count() == 40 and gaps.count() == 0
    first = sorted((tmp_path / "a").glob("*.gz"))[0]
    data = first.read_bytes()
    if harm == "missing":
        first.rename(tmp_path / "elsewhere")
    else:
        first.write_bytes(data[: len(data) // 2] if harm == "cut" else data[:200] + b"\0" * 40 + data[240:])
    with pytest.raises(ValueError, match="do not hold"):
        warc.verified_records(manifest)
    assert warc.read_archives(manifest)[1].count() > 0


def records(n=6):
    out = []
    for i in range(n):
        body = f"payload {i} ".encode() * 40
        out.append(warc.page_record(i, f"http://x/{i}", body, warc.sha1_base32(body), None))
    return out


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_costs_only_the_damaged_records(packed):
    parts = [warc.member(r) if packed else r for r in records()]
    whole = b"".join(parts)
    found = list(warc.salvage(whole))
    assert [x.headers["warc-record-id"] for x in found] == [f"<urn:page:{i}>" for i in range(6)]
    edges = np.cumsum([0, *map(len, parts)]).tolist()
    for hurt in range(6):
        middle = (edges[hurt] + edges[hurt + 1]) // 2
        for damaged in (
            whole[:middle] + bytes(b ^ 0x5A for b in whole[middle : middle + 3]) + whole[middle + 3 :],
            whole[:middle] + whole[middle + 5 :],
            whole[: edges[hurt]] + b"junk" + whole[edges[hurt] + 4 :],
        ):
            found = list(warc.salvage(damaged))
            good = [x for x in found if isinstance(x, warc.Record)]
            gaps = [x for x in found if isinstance(x, tuple)]
            assert [x.headers["warc-record-id"] for x in good] == [f"<urn:page:{i}>" for i in range(6) if i != hurt]
            assert [g[0] for g in gaps] == [edges[hurt]] and gaps[0][2]
            covered = sorted([(x.start, x.end) for x in good] + [(a, z) for a, z, _ in gaps])
            assert covered[0][0] == 0 and covered[-1][1] == len(damaged)
            assert all(a[1] == b[0] for a, b in zip(covered, covered[1:]))
    truncated = list(warc.salvage(whole[:-3]))
    assert sum(isinstance(x, warc.Record) for x in truncated) == 5 and isinstance(truncated[-1], tuple)
    assert list(warc.salvage(b"")) == [] and list(warc.salvage(b"no archive")) == [(0, 10, "no version line or no end of the header")]


def salvaged_ids(data):
    return [int(x.headers["warc-record-id"][10:-1]) for x in warc.salvage(data) if isinstance(x, warc.Record)]


def salvage_gaps(data):
    return [x for x in warc.salvage(data) if isinstance(x, tuple)]


@pytest.mark.parametrize("level", [0, 4])
def test_salvage_keeps_the_other_records_of_a_member(level):
    """Many records in one member: a wrong digest, a damaged and a cut member, a wrong checksum, a member behind it."""
    parts = records(400)
    wrong = [*parts]
    wrong[5] = parts[5].replace(b"payload 5", b"payload 6", 1)
    data = warc.member(b"".join(wrong), level)
    assert salvaged_ids(data) == [i for i in range(400) if i != 5]
    assert [g[:2] for g in salvage_gaps(data)] == [(0, len(data))] and "digest does not match" in salvage_gaps(data)[0][2]

    one, behind = warc.member(b"".join(parts), level), warc.member(records(401)[400], level)
    inflated = zlib.decompressobj(31).decompress(one[: len(one) // 2])
    whole = [i for i, end in enumerate(np.cumsum([*map(len, parts)])) if end <= len(inflated)]
    assert 100 < len(whole) < 300
    cut = one[: len(one) // 2]
    assert salvaged_ids(cut) == whole and salvage_gaps(cut)[-1][1:] == (len(cut), "the member has no end")
    assert salvaged_ids(cut + behind) == [*whole, 400]
    assert salvaged_ids(one[:-8] + bytes(8) + behind) == [*range(401)]
    hurt = len(one) // 2
    damaged = salvaged_ids(one[:hurt] + bytes(b ^ 0x5A for b in one[hurt : hurt + 40]) + one[hurt + 40 :] + behind)
    assert damaged[: len(whole)] == whole and damaged[-1] == 400 and damaged == sorted(set(damaged))

    plain = [p.replace(b"WARC-Block-Digest", b"X-Block").replace(b"WARC-Payload-Digest", b"X-Payload") for p in parts]
    member = warc.member(b"".join(plain), level)
    assert salvaged_ids(member[: len(member) // 2])
    assert salvaged_ids(member[:-8] + bytes(8) + behind)[-1] == 400 and (level == 0 or len(salvaged_ids(member[:-8] + bytes(8) + behind)) == 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3000), st.integers(0, 255)), max_size=6), st.booleans())
def test_salvage_never_invents_or_loses_untouched_records(edits, packed):
    parts = [warc.member(r) if packed else r for r in records()]
    data, edges = bytearray(b"".join(parts)), np.cumsum([0, *map(len, parts)])
    touched = set()
    for at, value in edits:
        at %= len(data)
        if data[at] != value:
            touched.add(int(np.searchsorted(edges, at, side="right")) - 1)
        data[at] = value
    good = {x.headers["warc-record-id"] for x in warc.salvage(bytes(data)) if isinstance(x, warc.Record)}
    assert good >= {f"<urn:page:{i}>" for i in range(6) if i not in touched}


def test_damaged_files_are_read_and_logged_on_spark(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * 50) for i in range(12)]
    manifest = warc.write_archives(table(spark, rows, PAGES).coalesce(1), f"file://{tmp_path}/b")
    [path] = list((tmp_path / "b").iterdir())
    data = path.read_bytes()
    path.write_bytes(data[:40] + b"\0\0\0\0" + data[44:])
    both = manifest.select("path").union(spark.createDataFrame([(f"file://{tmp_path}/b/none.warc.gz",)], "path string"))
    good, gaps = warc.read_archives(both)
    assert good.count() == 11 and good.where("payload is null").count() == 0
    assert sorted((r.start, r.end > 0) for r in gaps.collect()) == [(0, False), (0, True)]
