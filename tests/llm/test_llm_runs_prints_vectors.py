import hashlib
import math
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leadsift.llm import imatch as I
from leadsift.llm.bidiagonal import leading_directions
from leadsift.llm.imatch import imatch
from leadsift.llm.periodic import numbered, periodic_runs, text_runs, text_words
from leadsift.llm.queries import with_run
from leadsift.llm.whitening import whitening


# --- periodic runs ---------------------------------------------------------------------------
def plain_runs(w):
    out, n = [], len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            shorter = any(all(w[k] == w[k + d] for k in range(i, j + q - d)) for d in range(1, q))
            if j > i and size >= max(6, 4 * q) and not shorter:
                out.append((i, size, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(60))
def test_runs_equal_brute_force(seed):
    rng = np.random.default_rng(seed)
    n, kinds = int(rng.choice([0, 1, 5, 6, 24, 90, 300, 700])), int(rng.choice([1, 2, 3, 12, 10**6]))
    words = rng.integers(0, kinds, n)
    for _ in range(int(rng.integers(0, 4))):
        if n > 8:
            a = int(rng.integers(0, n - 4))
            p = int(rng.integers(1, max(2, (n - a) // 3)))
            end = min(n, a + p * int(rng.integers(2, 9)))
            words[a:end] = words[a + np.arange(end - a) % p]
    assert periodic_runs(words) == plain_runs(words.tolist())


def test_long_run_of_a_long_period():
    words = np.random.default_rng(5).integers(0, 3000, 120_000)
    words[7_000:] = words[7_000 + np.arange(113_000) % 20_011]
    assert (7_000, 113_000, 20_011) in periodic_runs(words)


def plain_row(text, doc_id):
    w = with_run(text_words(text or ""), doc_id)
    runs = plain_runs(w)
    drop = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    kept = b" ".join(x for i, x in enumerate(w) if i not in drop)
    listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
    return (
        len(runs), *best, 1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def test_text_runs(spark):
    tail = "ä b\x0bc  x " * 9
    texts = [None, "", " \n", "a " * 7, "a b " * 4, tail, "p q r s " * 40 + "t", "one two"] + [f"w{i} v{i % 3} u " * 30 for i in range(40)]
    data = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "z " * 9, None, None), (3, "a " * 7, "x", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, period string, start int")
    got = text_runs(docs, also=("doc_id",), edit=with_run)
    assert got.columns == ["doc_id", "text", *COLUMNS]
    rows = [(r["doc_id"], r["text"], *[r[c] for c in COLUMNS]) for r in got.collect()]
    key = repr
    assert sorted(rows, key=key) == sorted(((d, t, *plain_row(t, d)) for d, t, *_ in data), key=key)
    assert text_runs(docs.limit(0)).count() == 0
    assert any(numbered(text_words(t or "")).size and with_run(text_words(t or ""), d) != text_words(t or "") for d, t, *_ in data)


# --- document fingerprints -------------------------------------------------------------------
def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def spark_hash(*values):
    h = 42
    for v, kind in values:
        raw = v.encode() if kind == "s" else struct.pack("<" + kind, v)
        h = xxhash.xxh64_intdigest(raw, seed=h & (1 << 64) - 1)
    return signed(h)


def plain_terms(text):
    low = "".join(c if c.isascii() and c.isalnum() or not c.isascii() else " " for c in text.lower())
    return {spark_hash((w, "s")) for w in low.split(" ") if w}


def plain_print(band, every, text):
    hs = sorted(band if len(band) >= I.LEAST_TERMS else every)
    if not hs:
        return f"~{spark_hash((text, 's')) & (1 << 64) - 1:016X}"
    level, out = len(hs).bit_length() - 1, ""
    for lv in range(level, level + I.LEVELS):
        for j in range(I.SUBSETS):
            if lv < I.CELL_LEVEL:
                mine = [h for h in hs if spark_hash((41, "i"), (j, "q"), (h, "q")) & (1 << lv) - 1 == 0]
            else:
                mine = [h for h in hs if spark_hash((41, "i"), (h, "q")) & (1 << lv) - 1 == j]
            out += f"{spark_hash(*[(h, 'q') for h in mine]) & 0xFFFF:04X}" if mine else I.NONE
    return f"{level:02X}{out}"


def plain_likeness(a, b):
    if a == b:
        return 1.0
    if "~" in (a[0], b[0]):
        return 0.0

    def by_level(x):
        codes = [x[2 + 4 * i : 6 + 4 * i] for i in range(I.SUBSETS * I.LEVELS)]
        return {int(x[:2], 16) + k: codes[k * I.SUBSETS : (k + 1) * I.SUBSETS] for k in range(I.LEVELS)}

    la, lb = by_level(a), by_level(b)
    pairs = [p for k in la.keys() & lb.keys() for p in zip(la[k], lb[k], strict=True) if p != (I.NONE, I.NONE)]
    k = sum(x == y for x, y in pairs)
    return 2 * k / (len(pairs) + k) if pairs else 0.0


def plain_imatch(rows):
    texts = [t or "" for _, t in rows]
    df, n = {}, len(rows)
    for t in texts:
        for h in plain_terms(t):
            df[h] = df.get(h, 0) + 1
    lex = {h for h, c in df.items() if n * math.exp(-I.IDF_HIGH) <= c <= n * math.exp(-I.IDF_LOW)}

    def told(t):
        every = plain_terms(t)
        return plain_print(every & lex, every, t)

    order = sorted({(d is not None, d or 0, spark_hash((t or "", "s")), t or "") for d, t in rows})
    out = {}
    for i, (known, d, _, t) in enumerate(order):
        head = order[(i + 1) % len(order)][3][: len(t) // 4]
        edited = t[: len(t) - len(t) // 4] + head
        print_, edit, following = told(t), told(edited), told(order[(i + 1) % len(order)][3])
        out[(d if known else None, t)] = (
            d if known else None, len(t), hashlib.sha256(edited.encode()).hexdigest(), print_, edit,
            plain_likeness(print_, edit), plain_likeness(print_, following),
        )
    return sorted((out[(d, t or "")] for d, t in rows), key=repr)


@pytest.fixture(scope="module")
def prints(rows):
    rng = np.random.default_rng(3)
    vocabulary = [f"Term{i}" for i in range(300)]
    made = [(100 + i, " ".join(rng.choice(vocabulary, int(rng.integers(1, 90))))) for i in range(60)]
    return [(d, t) for d, t, _ in rows] + made + [(130, "tied id"), (500, "?! \U0001f600"), (501, "..."), (502, "...")]


@pytest.mark.parametrize("bound", [I.LEXICON_TERMS, 0])
def test_fingerprints_equal_brute_force(spark, prints, bound):
    """Both ways to look terms up, on nulls, empty and very long texts, tied ids and repeated rows."""
    docs = spark.createDataFrame([(*r, "x", 1) for r in prints], "doc_id long, text string, fingerprint string, _text int")
    got = imatch(docs, lexicon_bound=bound)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    for mine, plain in zip(rows, plain_imatch(prints), strict=True):
        assert mine[:5] == plain[:5]
        assert mine[5:] == pytest.approx(plain[5:])


def test_fingerprints_of_few_rows(spark):
    docs = spark.createDataFrame([(1, "a lone document of some words")], "doc_id long, text string")
    (row,) = imatch(docs).collect()
    assert row["near_next"] == 1.0 and row["n_chars"] == 29
    assert imatch(docs.limit(0)).count() == 0


# --- whitening -------------------------------------------------------------------------------
@pytest.mark.parametrize("kind", ["random", "graded", "equal", "blocks", "rank", "constant", "narrow", "zero"])
def test_leading_directions(kind):
    rng = np.random.default_rng(8)
    x = {
        "random": rng.standard_normal((300, 40)),
        "graded": rng.standard_normal((300, 30)) * np.logspace(0, -9, 30),
        "equal": np.vstack([np.eye(12)] * 3),
        "blocks": np.kron(np.eye(5), rng.standard_normal((20, 6))),
        "rank": rng.standard_normal((3, 20)),
        "constant": np.concatenate([rng.standard_normal((50, 5)), np.zeros((50, 3))], axis=1),
        "narrow": rng.standard_normal((9, 1)),
        "zero": np.zeros((4, 4)),
    }[kind]
    d = x.shape[1]
    r = np.vstack([np.linalg.qr(x, mode="r"), np.zeros((max(0, d - len(x)), d))])
    values, vectors = leading_directions(r, 4)
    exact = np.linalg.svd(x, compute_uv=False) ** 2
    np.testing.assert_allclose(values[: len(exact)], exact, atol=1e-13 * max(exact[0], 1e-300))
    assert vectors.shape[1] == min(4, np.linalg.matrix_rank(x))
    scaled = x @ vectors / np.sqrt(values[: vectors.shape[1]])
    np.testing.assert_allclose(scaled.T @ scaled, np.eye(vectors.shape[1]), atol=1e-10)


def test_whitening_equals_plain_solver(spark):
    rng = np.random.default_rng(2)
    good = (rng.standard_normal((400, 6)) * [4, 3, 2, 1, 1, 0.5] @ rng.standard_normal((6, 6))).astype(np.float32)
    good[5] = good[4]
    data = [(i, v.tolist(), "n", 1.5) for i, v in enumerate(good)]
    data += [(4, good[4].tolist(), "n", None), (None, good[7].tolist(), None, None), (901, None, None, None)]
    bad = [float("nan"), float("inf"), None]
    data += [(910 + i, [*good[0].tolist()[:5], b], "b", 0.0) for i, b in enumerate(bad)] + [(920, [], "e", 0.0), (921, [1.0], "e", 0.0)]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<float>, component string, _x double")
    got = whitening(vectors).toPandas()
    assert list(got.columns) == ["vec_id", "_x", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    x = np.floor(256 * good.astype(float)).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    v = (fit - s / n).T @ (fit - s / n) / n
    e, w = np.linalg.eigh(v)
    e, w = e[::-1], w[:, ::-1]
    assert len(got) == 4 * 402 and set(got["n"]) == {n} == {399}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-9
    for c in range(1, 5):
        mine = got[got["component"] == c].dropna(subset=["vec_id"]).drop_duplicates("vec_id").set_index("vec_id").loc[range(400)]
        exact = (x - s / n) @ w[:, c - 1] / np.sqrt(e[c - 1])
        sign = np.sign(exact @ mine["whitened"].to_numpy())
        np.testing.assert_allclose(sign * mine["whitened"], exact, atol=1e-9)
        np.testing.assert_allclose(mine["explained"], e[c - 1] / e.sum(), rtol=1e-9)
        assert mine["deviation"].tolist() == ((n * x - s) ** 2).sum(axis=1).tolist()


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening(spark.createDataFrame([], schema)).count() == 0
    same = spark.createDataFrame([(i, [-0.0, 2.5]) for i in range(5)], schema)
    assert whitening(same).count() == 0
    line = whitening(spark.createDataFrame([(1, [0.0, 1.0]), (2, [1.0, 1.0]), (3, [3e9, 1.0]), (4, [None, 1.0])], schema))
    rows = line.orderBy("vec_id").collect()
    assert [r["component"] for r in rows] == [1, 1, 1] and rows[0]["explained"] == pytest.approx(1.0)
    assert rows[2]["deviation"] is None


def test_triangles_are_merged_in_levels(spark):
    data = np.random.default_rng(4).standard_normal((500, 3)).tolist()
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(data)], "vec_id long, embedding array<double>").repartition(20)
    assert whitening(vectors).agg(F.max("identity_error")).first()[0] < 1e-10
