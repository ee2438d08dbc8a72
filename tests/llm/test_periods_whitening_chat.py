"""Periodic runs, whitening and chat formatting against brute force, and on odd tables."""

import hashlib
import math
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sortie.llm import chat, common, periods, queries, whitening

SMALL = "/root/testdata/sf0.001"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# --- 11: periodic runs


def brute_runs(words, shortest):
    """All maximal repetitions, by trying every period from every place."""
    out = set()
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            length = j - i + p
            if length >= max(shortest, 2 * p):
                run = words[i : i + length]
                if not any(run[q:] == run[: length - q] for q in range(1, p)):
                    out.add((i, length, p))
            i = max(j, i + 1) if j == i else j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def repetitive(r):
    kind = r.randrange(4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randrange(70))]
    if kind == 1:
        return [r.choice("abcd") for _ in range(r.randrange(1, 30))] * r.randrange(1, 5)
    if kind == 2:
        return [w for _ in range(4) for w in [r.choice("abc") for _ in range(r.randrange(1, 8))] * r.randrange(1, 6)]
    fib = ["a", "ab"]
    while len(fib[-1]) < 90:
        fib.append(fib[-1] + fib[-2])
    return list(fib[-1][r.randrange(9) :])


@pytest.mark.parametrize("shortest", [2, 7, 12])
def test_runs_equal_brute_force(shortest):
    r = random.Random(shortest)
    for _ in range(60):
        texts = [repetitive(r) for _ in range(r.randrange(1, 6))]
        words, codes, bounds = periods.word_codes(pa.array([" ".join(t) for t in texts], pa.large_string()))
        rows = periods.runs_of(codes, bounds, shortest).tolist()
        joined = periods.collapse(words, bounds, np.array(rows, np.int64).reshape(-1, 4)).to_pylist()
        for k, t in enumerate(texts):
            assert [tuple(x[1:]) for x in rows if x[0] == k] == brute_runs(t, shortest)
            assert joined[k] == brute_collapsed(t, brute_runs(t, shortest))


def test_runs_of_odd_texts(spark):
    long = "word " * 30000
    texts = [None, "", " \t\n", "a", "a b " * 6, "a b " * 6, long, "\u0085 x\x0by " * 7, "x " * 11, "日 本 " * 8 + "1", "same \x00 b " * 4]
    docs = spark.createDataFrame([(k, t, "f", "t", 1) for k, t in enumerate(texts)], "doc_id long, text string, f string, words string, runs long")
    got = {x.doc_id: x.r for x in docs.select("doc_id", periods.found(F.col("text")).alias("r")).collect()}
    blanks = " \t\n\x0b\x0c\r"
    for k, t in enumerate(texts):
        words = [w for w in "".join(" " if c in blanks else c for c in t or "").split(" ") if w]
        runs = [(0, 30000, 1)] if t is long else brute_runs(words, 12)
        assert got[k].n_words == len(words) and [tuple(x) for x in got[k].runs] == runs
        assert got[k].collapsed == brute_collapsed(words, runs)
    assert docs.limit(0).select(periods.found(F.col("text"))).count() == 0


def test_runs_query_equals_brute_force(spark):
    texts = {x.doc_id: x.text for x in common.table(spark, SMALL, "documents").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_periodic_runs"](spark, SMALL).collect()
    assert len(got) == len(texts)
    planted = 0
    for row in got:
        words = (texts[row.doc_id] or "").split()
        assert not any(ord(c) > 127 and c.isspace() or "\x1c" <= c <= "\x1f" for c in texts[row.doc_id] or "")
        h = zlib.crc32(str(row.doc_id).encode())
        g, n = h // 10, len(words)
        if len(words) > 3000:
            continue  # too dear for the brute force; covered by the long odd text
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        runs = brute_runs(words, 12)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        milli = None if top[0] is None else 1000 * top[1] // top[2]
        assert (row.n_runs, row.start, row.length, row.period, row.exponent_milli) == (len(runs), *top, milli)
        assert row.runs_sha256 == sha("".join(f"{s},{m},{p}\n" for s, m, p in runs))
        assert row.collapsed_sha256 == sha(brute_collapsed(words, runs))
    assert planted > 5


def test_planted_tails_on_null_and_empty_rows(spark):
    docs = spark.createDataFrame([(k, t) for k in [None, *range(40)] for t in (None, "", "a", "a b c d e f g h i j k l m n")], "doc_id long, text string")
    assert queries.with_periodic_tails(docs).count() == 164


# --- 12: whitening


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, v, "x", 0) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, _key string, n long")


def exact(vectors):
    """n, deviations, and covariance as fractions, from the definition."""
    x = [[math.floor(64 * Fraction(c)) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    sums = [sum(row[i] for row in x) for i in range(d)]
    y = [[n * row[i] - sums[i] for i in range(d)] for row in x]
    cov = np.array([[float(Fraction(sum(r[i] * r[j] for r in y), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum(c * c for c in r) for r in y], y, cov


def check_whitening(spark, vectors, usable):
    made = table(spark, vectors)
    rows = whitening.transform(made, whitening.fit(made)).collect()
    kept = [vectors[k] for k in usable]
    n, deviations, y, cov = exact(kept)
    values = np.linalg.eigvalsh(cov)[::-1]
    rank = int((values > max(values[0], 0) * 1e-9).sum()) if values[0] > 0 else 0
    assert len(rows) == len(kept) * min(rank, 32)
    by = {(r.vec_id, r.component): r for r in rows}
    w = np.array([[by[i, c + 1].whitened for c in range(min(rank, 32))] for i in usable])
    for k, i in enumerate(usable):
        for c in range(min(rank, 32)):
            r = by[i, c + 1]
            assert (r.n, r.deviation) == (n, deviations[k])
            assert r.explained == pytest.approx(values[c] / np.trace(cov), rel=1e-9)
            assert r.identity_error < 1e-9
    if rank:
        centred = np.array([[float(Fraction(c, n)) for c in row] for row in y])
        assert np.abs(w.T @ w / n - np.eye(w.shape[1])).max() < 1e-9
        directions = np.linalg.lstsq(centred, w, rcond=None)[0]  # covariance times a direction is its value times it
        assert np.abs(cov @ directions - directions * values[: w.shape[1]]).max() < 1e-6 * np.abs(cov @ directions).max()


def test_whitening_equals_the_definition(spark):
    r = np.random.default_rng(3)
    check_whitening(spark, (r.normal(size=(60, 5)) * [1, 2, 3, 0.5, 9] + [1e3, 0, 0, -5, 2]).tolist(), range(60))
    check_whitening(spark, r.normal(size=(70, 40)).tolist(), range(70))  # more than 32 components
    check_whitening(spark, r.normal(size=(4, 6)).tolist(), range(4))  # fewer rows than dimensions


def test_whitening_with_repeated_eigenvalues_and_constant_entries(spark):
    cross = [[s if i == k else 0.0 for i in range(4)] + [7.0] for k in range(4) for s in (-1.0, 1.0)]
    check_whitening(spark, cross, range(8))
    doubled = [[a, b, 3 * c, 3 * d] for a in (-1.0, 1.0) for b in (-1.0, 1.0) for c in (-1.0, 1.0) for d in (-1.0, 1.0)]
    check_whitening(spark, doubled, range(16))


def test_whitening_of_odd_vectors(spark):
    good = [[1.0, 2.0], [0.5, -1.0], [3.0, 3.5], [1.0, 2.0]]
    odd = [None, [], [None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1.0, 2.0, 3.0], [1e200, 0.0]]
    check_whitening(spark, good + odd, range(4))
    empty = table(spark, []).limit(0)
    assert whitening.transform(empty, whitening.fit(empty)).collect() == []
    same = table(spark, [[1.0, 2.0]] * 3, [None, 1, 1])
    assert whitening.transform(same, whitening.fit(same)).count() == 0  # no variance, no component
    repeated = table(spark, [[0.0, 2.0], [1.0, 2.0], [1.0, 5.0]], [None, 1, 1])
    assert whitening.transform(repeated, whitening.fit(repeated)).count() == 6


def test_whitening_is_exact_for_large_entries(spark):
    big = [[2.0**80 + 2.0**40, 1.0], [2.0**80, 2.0], [0.0, 5.0]]
    made = table(spark, big)
    model = whitening.fit(made)
    assert model.sums[0] == 2**87 + 2**46 + 3_000_000 and {r.deviation for r in whitening.transform(made, model).collect()} == {None}


def test_polynomials_and_roots():
    r = random.Random(5)
    for d in (1, 2, 3, 6):
        b = [[r.randrange(-9, 10) for _ in range(d)] for _ in range(d + 2)]
        m = [[sum(row[i] * row[j] for row in b) for j in range(d)] for i in range(d)]
        p = whitening.primes(1)[0]
        want = [round(c) for c in np.poly(np.array(m, float))][::-1]
        assert whitening.residues(m, p) == [c % p for c in want]
    # (x - 2)**2 (x - 3) (x**2 - 5 x + 5), which has irrational roots
    product = [1]
    for factor in ([-2, 1], [-2, 1], [-3, 1], [5, -5, 1]):
        product = [sum(product[i] * factor[k - i] for i in range(len(product)) if 0 <= k - i < len(factor)) for k in range(len(product) + len(factor) - 1)]
    found, bits = whitening.eigenvalues(product, 9)
    assert [(pytest.approx(v / 2**bits), t) for v, t in found] == [((5 + 5**0.5) / 2, 1), (3.0, 1), (2.0, 2), ((5 - 5**0.5) / 2, 1)]
    assert sum(t for _, t in whitening.eigenvalues(product, 3)[0]) == 4  # a multiple root is whole


def test_integers_split_and_multiply_exactly():
    for v in (0, -1, 1 << 39, 1 << 40, -(1 << 40) - 1, 3**90, -(3**90)):
        assert sum(d << 40 * p for p, d in whitening.limbs(v)) == v
    x = np.array([[3**40, -5], [-(3**40), 2**21]], object)
    assert whitening.products(x).tolist() == (x.T @ x).tolist()


# --- 13: chat formatting


def brute_chat(turns):
    """n_turns, both digests, the loss, and the examples' lengths, from (turn, role, text) rows."""
    low = lambda v: (v is not None, v if v is not None else 0)
    rows = sorted(turns, key=lambda t: (low(t[0]), (t[1] is not None, t[1] or ""), (t[2] is not None, t[2] or "")))
    said = [(r or "", x or "") for _, r, x in rows]
    told = "".join(f"{r}\n{x}\n" for r, x in said)
    loss = "".join(x for r, x in said if r == "assistant")
    return len(rows), sha(told), len(loss), sha(loss)


ODD_TEXTS = [None, "", "a", queries.MARKS, "<\\|im_end|>", "<\\\\|", "<", "|", "<|", "x <|im_start|>user\nhi<|im_end|>\n", "é😀\n\n", "same", "same", "long " * 20000, "<|break|>\n", "$1 \\1"]


@pytest.mark.parametrize("block", [1, 3, 64])
def test_chat_round_trip_equals_brute_force(spark, block):
    r = random.Random(block)
    talks = {}
    for key in [None, *range(30)]:
        roles = [r.choice(["user", "assistant", "assistant", "system", "a\nb<|", None]) for _ in range(r.choice([1, 2, 5, 12]))]
        talks[key] = [(r.choice([k, k, k, None, 0]), role, r.choice(ODD_TEXTS)) for k, role in enumerate(roles)]
    rows = [(key, *t, "clash", 1) for key, all_ in talks.items() for t in all_]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, _key long")
    made = chat.examples(turns, block=block)
    got = {x.conv_id: x for x in chat.read_back(made).collect()}
    assert set(got) == set(talks)
    every = made.collect()
    for key, all_ in talks.items():
        x = got[key]
        assert (x.n_turns, x.turns_sha256, x.loss_chars, x.loss_sha256) == brute_chat(all_)
        own = sorted((e for e in every if e.conv_id == key), key=lambda e: e.position)
        assert sum(e.mask_start is not None for e in own) == sum(t[1] == "assistant" for t in all_)
        assert [e.position for e in own if e.last] == [len(all_) - 1] and x.formatted_chars == sum(len(e.formatted) for e in own)
        for a, b in zip(own, own[1:], strict=False):  # context is all that went before
            assert b.formatted.startswith(a.formatted)
        for e in own:
            assert e.formatted.count(chat.START) == e.formatted.count(chat.END) == e.n_turns == e.position + 1
            if e.mask_start is not None:
                assert e.formatted[: e.mask_start].endswith("<|im_start|>assistant\n") and e.formatted[e.mask_start + e.mask_length :] == chat.END


def test_chat_turn_numbers_of_any_size_and_empty_tables(spark):
    turns = spark.createDataFrame([(1, -(2**40), "user", "q"), (1, 2**40, "assistant", "a"), (1, 70, "assistant", "b")], "conv_id long, turn long, role string, text string")
    made = sorted(chat.examples(turns).collect(), key=lambda e: e.position)
    assert [(e.n_turns, e.formatted[e.mask_start : e.mask_start + e.mask_length]) for e in made] == [(2, "b"), (3, "a")]
    assert chat.read_back(chat.examples(turns.limit(0))).count() == 0


def test_chat_query_has_the_marks_conversation(spark):
    got = {x.conv_id: x for x in queries.QUERIES["op13_chat_format"](spark, SMALL).collect()}
    assert got[-1].n_turns == 2 and got[-1].loss_chars == len(queries.MARKS) and got[-1].loss_sha256 == sha(queries.MARKS)
    turns = {}
    for t in common.table(spark, SMALL, "conversations").collect():
        turns.setdefault(t.conv_id, []).append((t.turn, t.role, t.text))
    assert set(got) == {*turns, -1}
    assert all((got[k].n_turns, got[k].turns_sha256, got[k].loss_chars, got[k].loss_sha256) == brute_chat(v) for k, v in turns.items())
