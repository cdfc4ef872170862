"""Chat formatting, fill-in-middle and importance resampling against brute force on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lossgrid.llm import chat, fill_middle, resample

CHATS = "conv_id long, turn long, role string, text string, formatted string, part string"
DOCS = "doc_id long, text string, n long, score string, row string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows, schema, parts=3):
    n = len(schema.split(","))
    return spark.createDataFrame([(*r, *["x" if "string" in k else 1 for k in schema.split(",")[len(r) : n]]) for r in rows], schema).repartition(parts)


# chat formatting

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[MSG]"]
BITS = [*MARKS, "\\", "<", "[", "/s>", "]", "INST]", "é", "🙂", "\n", "", "a", "$1", r"<\/s>", r"[\\MSG]"]


def awkward_chats():
    rng = random.Random(4)
    rows = []
    for c in range(25):
        for t in range(rng.randint(1, 9)):
            text = rng.choice([None, "", *["".join(rng.choices(BITS, k=rng.randint(1, 8))) for _ in range(6)]])
            rows.append((c, t, rng.choice(["user", "assistant", "assistant", "system", "tool", "[INST]", "", None]), text))
    rows += [(None, 0, "user", "no id"), (None, 1, "assistant", "x"), (40, None, "assistant", "null turn"), (40, 0, "user", "q")]
    rows += [(41, 3, "user", "tie b"), (41, 3, "user", "tie a"), (41, 3, "assistant", "tie c"), (42, 0, "assistant", "long " * 40_000)]
    rows += [(43, 7, "assistant", "same")] * 30 + [(44, i, ("user", "assistant")[i % 2], f"</s>{i}") for i in range(60)]
    return rows + rows[:4]


def brute_chats(rows):
    chats = defaultdict(list)
    for c, t, r, x in rows:
        chats[c].append((t is not None, t or 0, r or "", x or ""))
    return {c: [(r, x) for *_, r, x in sorted(v, key=lambda k: (k[0], k[1], k[2].encode(), k[3].encode()))] for c, v in chats.items()}


@pytest.mark.parametrize("most", [512, 3])
def test_chats_read_back_as_they_went_in(spark, most):
    rows = awkward_chats()
    out = chat.format_chats(table(spark, rows, CHATS), most_turns=most)
    out = out.withColumns(
        {"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_spans"))}
    )
    got, want = out.collect(), brute_chats(rows)
    assert len(got) == len(want)
    for r in got:
        turns = want[r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert r["loss"] == [x for role, x in turns if role == "assistant"] and r["n_turns"] == len(turns)
        blocks = sum(1 for i, t in enumerate(turns) if i == 0 or turns[i - 1][0] != t[0])
        assert r["formatted"].startswith("<s>") and r["formatted"].count("[MSG]") >= len(turns) - blocks
        assert r["formatted"].count("<s>") == 1
        assert r["formatted"].count("</s>") == sum(1 for i, t in enumerate(turns) if t[0] == "assistant" and (i == 0 or turns[i - 1][0] != "assistant"))


def test_long_chats_give_the_same_text(spark):
    df = table(spark, awkward_chats(), CHATS)
    pairs = [sorted(map(str, chat.format_chats(df, most_turns=m).collect())) for m in (512, 5)]
    assert pairs[0] == pairs[1]


def test_a_row_that_repeats_very_often_is_cut_into_parts(spark):
    rows = [(1, 0, "user", "q")] * 3 + [(1, 1, "assistant", "a")] * 70 + [(1, 2, "user", "z")]
    long, short = (chat.format_chats(table(spark, rows, CHATS), most_turns=m).first() for m in (8, 512))
    assert long == short and long["n_turns"] == 74 and len(long["loss_spans"]) == 70


def test_chats_of_an_empty_table(spark):
    assert chat.format_chats(table(spark, [], CHATS)).collect() == []


def test_other_marks_and_columns(spark):
    template = chat.Template("<b>", {"user": ("<u>", "</u>"), "assistant": ("<a>", "</a>")}, ("<r>", "</r>"), "<+>")
    df = table(spark, [(1, 0, "user", "<u>"), (1, 1, "assistant", "<+></a>$")], "c long, t long, r string, x string")
    out = chat.format_chats(df, "c", "t", "r", "x", template).withColumn("back", chat.read_turns(F.col("formatted"), template)).first()
    assert out["formatted"] == r"<b><u><\u></u><a><\+><\/a>$</a>"
    assert [tuple(t) for t in out["back"]] == [("user", "<u>"), ("assistant", "<+></a>$")]


def test_chat_plan_has_no_python(spark):
    plan = chat.format_chats(table(spark, awkward_chats(), CHATS))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


# fill-in-middle

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
PIECES = ["a", "Zz", "word", "@", "[", "`", "{", "é", "漢", "🙂", "\x80", "ÿ", "\n", "\x00", " ", "0", "AbcdefghijK", "ſ", "<", "<P", "ABCDEFGH"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=20).map("".join), min_size=1, max_size=5))
def test_units_equal_the_regular_expression(texts):
    parts = [t.encode() for t in texts]
    bounds = np.cumsum([0, *map(len, parts)])
    found = fill_middle.units(np.frombuffer(b"".join(parts), np.uint8), bounds)
    ranks = found.ends.rank(bounds)
    for i, t in enumerate(texts):
        want = UNIT.findall(t)
        assert ranks[i + 1] - ranks[i] == len(want)
        ends = found.ends.select(ranks[i] + np.arange(1, len(want) + 1)) - bounds[i]
        assert ends.tolist() == np.cumsum([len(u.encode()) for u in want]).tolist()
        starts = found.starts.rank(bounds[i] + np.concatenate([[0], ends]).astype(np.int64))
        assert np.diff(starts).tolist() == [len(u) for u in want]


def awkward_docs(n=150):
    rng = random.Random(9)
    rows = [(i, "".join(rng.choices(PIECES, k=rng.choice([0, 1, 2, 7, 40, 400])))) for i in range(n)]
    rows += [(900, None), (901, ""), (902, "has <P> in it"), (903, "<M>"), (904, "<" * 50), (None, "no id at all"), (None, None)]
    rows += [(905, "letters" * 30_000), (906, "漢" * 50_000), (907, "x<S>"), (908, "><S"), (-3, "negative id, some words")]
    return rows + rows[:5] + [(3, "other text of a repeated id")]


def brute_fill(i, text, seed=1, rate=90, first=20):
    text, u = text or "", UNIT.findall(text or "")
    x = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(k in text for k in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (i, len(u), "plain", None, None, text, text)
    if h[3] % 100 < first:
        return (i, len(u), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}", text)
    return (i, len(u), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}", text)


@pytest.mark.parametrize("pass_bytes", [1 << 22, 64])
@pytest.mark.parametrize("options", [{}, {"seed": 5, "rate": 100, "suffix_first": 50}])
def test_fill_in_middle_matches_brute_force(spark, monkeypatch, pass_bytes, options):
    monkeypatch.setattr(fill_middle, "PASS_BYTES", pass_bytes)
    rows = awkward_docs()
    out = fill_middle.fill_in_middle(table(spark, rows, DOCS), **options)
    out = out.withColumn("back", fill_middle.restored(F.col("output"), F.col("form")))
    names = dict(seed="seed", rate="rate", suffix_first="first")
    want = [brute_fill(i, t, **{names[k]: v for k, v in options.items()}) for i, t in rows]
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    assert {w[2] for w in want} == {"plain", "psm", "spm"}


def test_fill_in_middle_of_an_empty_table(spark):
    assert fill_middle.fill_in_middle(table(spark, [], DOCS)).collect() == []


# importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, sizes):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    out = [" ".join(words[i : i + n]) for n in range(sizes[0], sizes[1] + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(g.encode()) for g in out]


def brute_resample(docs, target, sizes=(1, 1), buckets=10_000, least=20, percent=10, seed=2024):
    parts = [(i, *grams(t, sizes)) for i, t in docs]
    s = Counter(c % buckets for *_, g in parts for c in g)
    t = Counter(c % buckets for (x,) in target for c in grams(x, sizes)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for i, n, g in parts:
        weight = sum(gain[c % buckets] for c in g) // len(g) if g else 0
        h = int(sha(f"{seed}:{'' if i is None else i}")[:8], 16)
        rows.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    k = percent * len(enough) // 100
    out = [(i, n, w, x, rank if rank <= k else None) for rank, (i, _, n, w, x) in enumerate(enough, 1)]
    return out + [(i, n, w, x, None) for i, words, n, w, x in rows if words < least]


def resample_rows():
    rng = random.Random(2)
    words = ["The", "cat", "naïve", "x1", "漢字", "ÉTÉ", "don't", "42", "a_b", "K", "ﬁ", "…", "\x80", "b"]
    rows = [(i, rng.choice([" ", ", ", "\n-"]).join(rng.choices(words, k=rng.choice([0, 1, 19, 20, 21, 60])))) for i in range(200)]
    rows += [(900, None), (901, ""), (902, " .,"), (None, "cat " * 30), (None, "cat " * 30), (903, "the " * 60_000)]
    return rows + rows[2:6] * 3 + [(5, "other text, same id, " * 8)]


@pytest.mark.parametrize("options", [{}, {"sizes": (1, 3), "buckets": 97, "percent": 35, "least": 5, "seed": 7}])
@pytest.mark.parametrize("target", [[("The cat naïve x1",), (None,), ("K k K",)], []])
def test_resampling_matches_brute_force(spark, options, target):
    rows = resample_rows()
    names = {"least": "least_words"}
    out = resample.importance_resample(
        table(spark, rows, DOCS, 5),
        table(spark, target, "text string"),
        **{names.get(k, k): v for k, v in options.items()},
    )
    # repeated rows of one id may change places among themselves, which shows in no column
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, brute_resample(rows, target, **options)))


def test_overlapped_scan_finds_every_run():
    data = resample.collapsed("  Aa--b, c\td d é9 ".encode())
    assert data == "aa b c d d é9".encode()
    for n in range(1, 8):
        words = data.split(b" ")
        want = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)]
        assert [m[0] for m in resample.ngram_pattern(n).finditer(data, overlapped=True)] == want


def test_resampling_of_empty_tables(spark):
    empty = table(spark, [], DOCS)
    assert resample.importance_resample(empty, empty).collect() == []
