"""Fill-in-middle, suffix dedup and vector codes against plain Python on NULLs, ties, repeats, empty and long inputs."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lettermark.llm import codes, fim, suffixes

rng = random.Random(11)
CLASHING = "doc_id long, text string, frames string, n long, doc long, key string, spans string, form string"


def sha(raw):
    return hashlib.sha256(raw if isinstance(raw, bytes) else raw.encode()).hexdigest()


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.fixture(scope="module")
def texts():
    some = ["", None, "a", "é€𝄞" * 50, "with <P> inside", "x<S", "<M>", "\x00 nul \x00", "line\nline\n" * 30, "long " * 40_000]
    rows = [(i, t) for i, t in enumerate(some * 4)]
    return rows + [(7, "same row"), (7, "same row"), (7, "same id"), (None, "no id"), (None, None)]


def middle_by_hand(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, n, "plain", None, None, sha(text), sha(text)
    p, m, s = text[:a], text[a:b], text[b:]
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return doc_id, n, "spm" if h4 % 100 < 20 else "psm", a, b - a, sha(out), sha(text)


@pytest.mark.parametrize("size", [4, 64, fim.FRAME])
def test_fill_in_middle(spark, texts, size):
    own = [t for t in texts if size > 4 or not t or len(t) < 10_000]
    docs = spark.createDataFrame([(i, t, "f", 1, 2, "k", "s", "o") for i, t in own], CLASHING).repartition(3)
    store = fim.store_frames(docs, size)
    made = fim.fill_in_middle(store)
    want = sorted((middle_by_hand(i, t) for i, t in own), key=repr)
    assert rows_of(fim.with_digests(made), "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256") == want
    assert {r[2] for r in want} == {"plain", "psm", "spm"}
    for r in made.collect():  # an output is seekable like a store: its counts are those of its frames
        parts = [fim.zstandard.ZstdDecompressor().decompress(f).decode() for f in r["frames"]]
        assert list(np.cumsum([len(p) for p in parts])) == r["ends"]
        assert all(len(p.encode()) <= fim.FRAME for p in parts)


def test_fill_in_middle_of_nothing(spark):
    docs = spark.createDataFrame([], CLASHING)
    assert fim.with_digests(fim.fill_in_middle(fim.store_frames(docs))).count() == 0


def test_find_across_frames():
    raw = "abc<P>def<S>gh<M>" * 3
    source = fim.Frames([f for f, _ in fim.compressed(raw.encode(), 4)])
    for mark in (b"<P>", b"<S>", b"<M>", b"zz"):
        for start in range(len(raw)):
            assert source.find(mark, start) == raw.encode().find(mark, start)


def test_previous_factors():
    for _ in range(40):
        text = bytes(rng.choices(b"ab", k=rng.randint(1, 60)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(len(text)) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= len(text) or j + k >= len(text)), len(text))
        lcp = np.array([common(a, b) for a, b in zip(order, order[1:], strict=False)], np.int64)
        want = [max((common(i, j) for j in range(i)), default=0) for i in order]
        assert suffixes.previous_factors(lcp, np.array(order)).tolist() == want


def repeats_by_hand(rows, length):
    keys = sorted({(i is not None, i or 0, t or "") for i, t in rows}, key=lambda k: k[:2])
    seen, out = set(), {}
    for known, i, t in keys:
        raw = t.encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            window = raw[p : p + length]
            if window in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(window)
        runs = sum(1 for k in range(len(raw)) if gone[k] and not (k and gone[k - 1]))
        out[known, i, t] = (len(raw), sum(gone), runs, bytes(c for c, g in zip(raw, gone, strict=True) if not g))
    return sorted(((i, *out[i is not None, i or 0, t or ""]) for i, t in rows), key=repr)


def cut(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "f", 1, 2, "k", "s", "o") for i, t in rows], CLASHING).repartition(3)
    return [(i, n, r, s, bytes(kept)) for i, n, r, s, kept in rows_of(suffixes.cut_repeats(docs, **options), "doc_id", "n_bytes", "n_removed", "n_spans", "kept")]


def passages():
    words = [f"w{k}é" for k in range(60)]
    shared = [" ".join(rng.choices(words, k=40)) for _ in range(4)]
    rows = [(i, " ".join([*rng.choices(words, k=rng.randint(0, 30)), rng.choice(shared), *rng.choices(words, k=rng.randint(0, 30)), rng.choice(shared)])) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(5)]
    rows += [(110, None), (111, ""), (112, "short"), (113, "x" * 400), (114, "ab" * 300), (115, "x" * 99), (116, "y" * 100), (117, "z" * 101)]
    return rows + [(118, "q" * 150), (118, "q" * 150), (None, shared[0]), (None, None)]


@pytest.mark.parametrize("options", [{}, {"most": 1}, {"most": 3, "k": 20}, {"length": 12, "k": 8}, {"length": 12, "k": 8, "most": 2}, {"length": 30, "k": 30}])
def test_suffix_dedup(spark, options):
    rows = passages()
    assert cut(spark, rows, **options) == sorted(repeats_by_hand(rows, options.get("length", 100)), key=repr)


def test_suffix_dedup_of_long_texts(spark):
    long = "".join(rng.choices("abcdefgh ", k=suffixes.PIECE + 5_000))
    rows = [(1, long), (2, "start " + long[1_000:] + " end"), (3, long[suffixes.PIECE - 300 : suffixes.PIECE + 300])]
    assert cut(spark, rows) == repeats_by_hand(rows, 100)


def test_suffix_dedup_of_one_id_and_of_nothing(spark):
    common = "".join(rng.choices("abcdefgh ", k=300))
    got = cut(spark, [(1, common + "one"), (1, common + "two")])
    assert sorted(r[2] for r in got) == [0, 300]
    assert cut(spark, []) == []


def test_anchors_depend_on_the_window_only():
    data = np.frombuffer(bytes(rng.choices(b"abcd", k=3_000)), np.uint8)
    for length, k in ((100, 64), (100, 20), (12, 8), (30, 30)):
        anchors = suffixes.Anchors(length, k)
        places = anchors.places(data)
        assert ((places >= np.arange(len(places))) & (places + k <= np.arange(len(places)) + length)).all()
        for i in range(0, len(places), 37):
            assert anchors.places(data[i : i + length])[0] == places[i] - i


def codes_by_hand(rows, entries=64, rounds=2, parts=16):
    kept = [(i, label, [int(np.floor(np.float64(v) * 256)) for v in e]) for i, e, label in rows if e and all(v is not None and np.isfinite(v) for v in e)]
    kept = sorted((r for r in kept if len(r[2]) == len(kept[0][2])), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    w = len(kept[0][2]) // parts
    cut = [[x[p * w : p * w + w] for p in range(parts)] for _, _, x in kept]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]
    near = lambda v, book: min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut:
                groups.setdefault(near(v[p], books[p])[1], []).append(v[p])
            for k, members in groups.items():
                books[p][k] = [sum(c) // len(members) for c in zip(*members, strict=True)]
    out, by_label = [], {}
    for (i, label, _), v in zip(kept, cut, strict=True):
        best = [near(v[p], books[p]) for p in range(parts)]
        out.append((i, label, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        by_label[label] = by_label.get(label, 0) + out[-1][3]
    print_ = sha(",".join(str(c) for book in books for e in book for c in e))
    return sorted(((i, code, error, by_label[label], print_) for i, label, code, error in out), key=repr)


@pytest.mark.parametrize("size", [16, 32, 48])
def test_vector_codes(spark, size):
    near = np.random.default_rng(size)
    rows = [(i, (near.normal(size=size) * near.choice([0.01, 1.0])).tolist(), int(near.integers(3))) for i in range(250)]
    rows += [(300 + i, list(rows[3][1]), None) for i in range(4)] + [(2, rows[9][1], None), (None, rows[5][1], 1)]
    rows += [(400, None, 1), (401, [], 1), (402, [None] * size, 1), (403, [float("nan")] * size, 1), (404, [float("inf")] + [0.0] * (size - 1), 1), (405, [1.0] * 20, 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"x": F.lit(1), "code": F.lit("c")}).repartition(3)
    columns = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
    for b in (8, 1):
        assert rows_of(codes.vector_codes(df, b=b), *columns) == codes_by_hand(rows)
    assert rows_of(codes.vector_codes(df, rounds=5, entries=9), *columns) == codes_by_hand(rows, 9, 5)


def test_vector_codes_of_few_and_of_large(spark):
    rows = [(i, [v] * 16, 0) for i, v in enumerate([0.0, 1e6, 1e6, -3e6])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert rows_of(codes.vector_codes(df), "vec_id", "code", "error", "label_error", "codebooks_sha256") == codes_by_hand(rows)
    assert codes.vector_codes(df.limit(0)).count() == 0


def test_bounds_never_decide_wrongly():
    r = np.random.default_rng(3)
    for b in (0, 1, 5, 63):
        x, entries = r.integers(-300, 300, (500, 4)), r.integers(-300, 300, (64, 4))
        state, _ = codes.measured(x, entries, b)
        for step in (1, 20, 400):
            after = entries + r.integers(-step, step + 1, entries.shape)
            state, exact, _ = codes.reassigned(x, after, codes.moved(state, codes._moves(entries[None], after[None])[0]))
            want = codes.squared(x, after)
            assert (state.code == want.argmin(1)).all() and (exact == want.min(1)).all()
            if b > 1:
                state = codes.narrowed(state, b - 1)
                b -= 1
            entries = after


def test_squares_and_roots_are_exact():
    big = np.array([[2**40, 3]]), np.array([[-(2**40), 5]])
    assert codes.squared(*big)[0, 0] == 2**82 + 4 and codes.own_squared(big[0], big[1][0])[0] == 2**82 + 4
    roots = np.array([0, 1, 2, 3, 4, 2**52 - 1, 2**52, (2**26 + 1) ** 2 - 1])
    assert codes.floor_root(roots).tolist() == [0, 1, 1, 1, 2, 2**26 - 1, 2**26, 2**26]
    assert codes.ceil_root(roots).tolist() == [0, 1, 2, 2, 2, 2**26, 2**26, 2**26 + 1]
