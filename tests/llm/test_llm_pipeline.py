"""The pipeline's stages on odd rows, and its rows against a brute-force version."""

import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
NASTY = ["idiot", "scum", "moron", "vermin"]


def planted():
    """(rows, toxic ids, benchmark texts): clean, toxic, copied, nearly copied and leaked documents."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(4000)]
    items = [" ".join(rng.choices(words, k=25)) for _ in range(3)]
    texts = {i: " ".join(rng.choices(words, k=rng.choice([12, 60, 400, 3000]))) for i in range(100)}
    for i in range(100, 180):  # toxic ones
        texts[i] = " ".join(rng.choices(words, k=30) + rng.choices(NASTY, k=6))
    for i in range(180, 200):  # exact and near copies of clean ones
        near = texts[i - 180].split()
        if i % 2 and len(near) > 100:
            near[len(near) // 2] = "changed"
        texts[i] = " ".join(near)
    for i in range(200, 206):  # benchmark passages, upper case and other punctuation included
        leak = items[i % 3].upper().split()[5 : 5 + (10 if i < 204 else 9)]
        texts[i] = " ".join(rng.choices(words, k=80)) + " " + ", ".join(leak) + " " + " ".join(rng.choices(words, k=20))
    texts[206] = texts[200]  # a copy of a leaked one
    texts[207], texts[208] = None, ""
    rows = [(i, t, "en", ["a", "b", None][i % 3] if i >= 40 else "a", len(t or "")) for i, t in texts.items()]
    return rows, set(range(100, 180)), items


def clusters(texts):
    """Smallest id that each text reaches by links of at least 0.8 between sets of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    least = {i: i for i in texts}
    for i in texts:
        for j in texts:
            if j < i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = least[i], least[j]
                least = {k: min(a, b) if v in (a, b) else v for k, v in least.items()}
    return least


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, toxic, items = planted()
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(180)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    bench = [*enumerate(items), (7, None), (8, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_equals_brute_force(spark, folder):
    rows, toxic, items = planted()
    left = {i: t for i, t, *_ in rows if i not in toxic}
    least = clusters(left)
    left = {i: t for i, t in left.items() if least[i] == i}
    windows = {" ".join(w[k : k + 10]) for w in (x.split() for x in items) for k in range(len(w) - 9)}
    left = {i: t for i, t in left.items() if not any(x in (t or "").lower().replace(",", "") for x in windows)}
    assert not {200, 201, 202, 203, 206} & left.keys() and {204, 205} <= left.keys()

    got = cp.run(spark, folder).collect()
    assert {r.doc_id for r in got} == {i for i, t in left.items() if t}
    assert all(r.n_chars == len(r.text) for r in got)
    taken, source = defaultdict(Counter), {i: s for i, _, _, s, _ in rows}
    for r in got:
        assert r.source == source[r.doc_id]
        taken[r.doc_id].update(r.text.split())
    for i, found in taken.items():
        once = Counter(left[i].split())
        assert all(n <= found[w] <= 2 * n for w, n in once.items()) and found.keys() == once.keys()
    total = sum(len(t.split()) for t in left.values() if t)
    assert abs(sum(sum(c.values()) for c in taken.values()) - 1.5 * total) < 3 * cp.BLOCK_WORDS
    shards = defaultdict(list)
    for r in got:
        shards[r.shard].append(r.slot)
    sizes = [len(shards[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1 and all(sorted(x) == list(range(len(x))) for x in shards.values())


ODD = {
    "score": 0.5, "predicted": 7, "held_out": True, "is_copy": False, "duplicate_of": 9, "n_words": 3, "hit_spans": "x",
    "hit_items": "y", "contaminated": False, "size": 1, "taken": 2, "target": 1.5, "mix_shard": 4, "_row": 5, "_record": "r",
    "_text": "t", "_words": "w", "_source": "s", "_size": 6, "_hash": 8, "_bits": 10, "dotted.name": "d",
}


@pytest.mark.parametrize("name", [n for n, _ in cp.STAGES])
def test_stages_keep_odd_rows_and_columns(spark, folder, rows, name):
    stage = dict(cp.STAGES)[name]
    plain = spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], COLUMNS)
    docs = plain.select("*", *[F.lit(v).alias(c) for c, v in ODD.items()])
    got = stage(spark, docs, folder)
    assert got.columns == docs.columns + (["shard", "slot"] if name == "sharding" else [])
    kept = got.collect()
    assert all(r[c] == v for r in kept for c, v in ODD.items())
    before = Counter((i, t) for i, t, _ in rows)
    after = Counter((r.doc_id, r.text) for r in kept)
    if name == "toxicity":
        toxic = Counter({(None, "no id here, idiot"): 1})
        assert after in (before, before - toxic)
    if name in ("decontamination", "sharding"):
        assert after == before
    if name == "simhash_near_dedup":
        texts = Counter(t or "" for _, t in after.elements())
        assert max(texts.values()) == 1 and {1, 6, 7, 8, 9} <= {i for i, _ in after} and after <= before
    if name == "mixing":
        assert {r.doc_id for r in kept} == {i for i, t, _ in rows if t}
    assert stage(spark, docs.limit(0), folder).count() == 0
