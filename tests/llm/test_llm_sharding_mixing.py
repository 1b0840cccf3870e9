from collections import Counter, defaultdict

from pyspark.sql import functions as F

from leadsift.llm.mixing import Mix, _permuted, source_targets
from leadsift.llm.sharding import shuffled_shards


def test_shards_hold_every_row_and_differ_by_one(docs, rows):
    for shards in (1, 4, 40):
        got = shuffled_shards(docs, shards, bucket_bytes=1 << 14).collect()
        assert Counter((r.doc_id, r.text) for r in got) == Counter((r[0], r[1]) for r in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r["shard"]].append(r["slot"])
        counts = [len(slots.get(s, ())) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_shards_shuffle_and_repeat(spark):
    ids = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    first, again = ([(r.doc_id, r.shard, r.slot) for r in shuffled_shards(ids, 8).orderBy("shard", "slot").collect()] for _ in range(2))
    assert first == again and [x[0] for x in first] != sorted(x[0] for x in first)
    assert shuffled_shards(ids.limit(0), 8).count() == 0


def water_level(sizes, weights, share, cap, least):
    want, low, high = share * sum(sizes), 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        if sum(max(least * s, min(cap * s, mid * w)) for s, w in zip(sizes, weights)) < want:
            low = mid
        else:
            high = mid
    return [max(least * s, min(cap * s, high * w)) for s, w in zip(sizes, weights)]


def test_targets_equal_resharing_until_none_is_above(spark):
    names, sizes = ["B", "a", "b", "é", None], [1000, 10, 400, 77, 0]
    df = spark.createDataFrame([(str(n), n, s) for n, s in zip(names, sizes)], "_source string, source string, source_size long")
    for share, cap, least in ((1.5, 2, 0), (1.5, 2, 1), (2.0, 2, 0), (0.3, 2, 0)):
        got = {r["source"]: r["target"] for r in source_targets(df, (3, 1, 2), share, cap, least).collect()}
        want = water_level(sizes, [3, 1, 2, 3, 1], share, cap, least)
        assert all(abs(got[n] - w) < 1e-6 for n, w in zip(names, want)), (share, got, want)


def test_permutation_hits_every_place_once(spark):
    for n in (1, 2, 7, 1000):
        x = spark.range(n).select(_permuted(F.col("id"), F.lit(n).cast("long"), [F.lit("k")], 1).alias("p"))
        assert sorted(r.p for r in x.collect()) == list(range(n))


def test_mix_takes_near_target_and_never_over_twice(docs, rows):
    mix = Mix(docs, block_words=16)
    got = mix.documents().collect()
    assert Counter((r.doc_id, r["source"]) for r in got) == Counter((r[0], r[2]) for r in rows)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    for source in {r["source"] for r in got}:
        mine = [r for r in got if r["source"] == source]
        assert mine[0].source_size == sum(r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= 16
    again = {(r.doc_id, r["size"], r.taken) for r in Mix(docs, block_words=16).documents().collect()}
    assert again == {(r.doc_id, r["size"], r.taken) for r in got}


def test_pieces_make_whole_texts_and_the_words_taken(docs, rows):
    mix = Mix(docs, least=1.0, block_words=16)
    pieces, taken = mix.pieces().collect(), mix.documents().agg(F.sum("taken")).first()[0]
    assert sum(len(p.text.split()) for p in pieces) == taken
    first = defaultdict(list)
    for p in pieces:
        if p.mix_pass == 0 and p.doc_id is not None and p.doc_id != 8:
            first[p.doc_id].append((p.mix_block, p.text))
    for doc_id, text, _ in rows:
        if doc_id not in (None, 8) and text:
            assert "".join(t for _, t in sorted(first[doc_id])) == text
    assert Mix(docs.limit(0)).documents().count() == 0


def test_shards_draw_the_slots_of_the_sources(spark):
    """Quotas are met exactly, counts of a shard scatter as a multinomial draw does, and the result rests on them."""
    docs = spark.range(600).select(
        F.col("id").alias("doc_id"), F.repeat(F.lit("w "), 40).alias("text"), F.when(F.col("id") < 300, "a").when(F.col("id") < 500, "b").otherwise("c").alias("source")
    )
    mix = Mix(docs, block_words=4, shard_slots=300)
    draws = mix.draws().collect()
    quota = {r["source"]: round(r["target"] / 4) for r in mix.targets.collect()}
    for source, slots in quota.items():
        mine = sorted((r["mix_shard"], r["_start"], r["_count"]) for r in draws if r["_source"] == f"={source}")
        assert [s for _, s, _ in mine] == [sum(c for _, _, c in mine[:i]) for i in range(len(mine))]
        assert sum(c for _, _, c in mine) == slots
        shards = sum(quota.values()) // 300
        assert len(mine) == shards
        mean = slots / shards
        chi = sum((c - mean) ** 2 / mean for _, _, c in mine)
        assert 0.2 * shards < chi < 2.5 * shards
    got = mix.documents()
    assert "mix_shard" in got._jdf.queryExecution().optimizedPlan().toString()
    drawn = mix._drawn().groupBy("mix_shard", "_source").agg(F.countDistinct("_block", "mix_pass").alias("n")).collect()
    assert {(r["mix_shard"], r["_source"], r["n"]) for r in drawn} == {(r["mix_shard"], r["_source"], r["_count"]) for r in draws}
    assert {r.n_shards > 0 for r in got.where("taken > 0").collect()} == {True}
