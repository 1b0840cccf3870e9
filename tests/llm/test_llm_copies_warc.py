import base64
import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from leadsift.llm import simhash, warc
from leadsift.llm.graph import components
from leadsift.llm.simhash import GrayIndex, gray_rank, linked, near_copies, shingle_hashes, simhash_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, most):
    label = list(range(len(values)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(values):
            for j, b in enumerate(values):
                if (a ^ b).bit_count() <= most and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_fingerprints_and_components_equal_brute_force(docs, rows):
    got = simhash_components(docs).collect()
    prints = [brute_fingerprint(t) for _, t, _ in rows]
    labels = brute_components(prints, 2)
    least = {g: min((r[0] for r, k in zip(rows, labels) if k == g and r[0] is not None), default=None) for g in labels}
    want = Counter((r[0], f"{p:016x}", least[g]) for r, p, g in zip(rows, prints, labels))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == want
    assert simhash_components(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("words", "most"), [(1, 2), (1, 7), (4, 30)])
def test_index_finds_all_pairs(words, most):
    rng = np.random.default_rng(words * 100 + most)
    centres = rng.integers(0, 2**63, (40, words), np.uint64)
    points = []
    for c in centres:
        for _ in range(20):
            p = c.copy()
            for bit in rng.integers(0, 64 * words, most):
                p[bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
            points.append(p)
    points = np.unique(np.array(points), axis=0)
    index, n = GrayIndex(points), len(points)
    a, b = (index.order[x].tolist() for x in index._found(np.arange(n), np.arange(n), None, most))
    found = {tuple(sorted(p)) for p in zip(a, b)}
    far = np.bitwise_count(points[:, None] ^ points[None]).sum(2)
    assert found == {(i, j) for i, j in zip(*np.nonzero(far <= most)) if i < j}
    labels = brute_components([int.from_bytes(p.tobytes(), "little") for p in points], most)
    assert len(set(zip(index.roots(most).tolist(), labels))) == len(set(index.roots(most).tolist())) == len(set(labels))


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_links_of_a_hot_key_connect_what_all_pairs_connect(spark, block):
    rng = random.Random(block)
    chain = [(1 << i) - 1 for i in range(40)]
    star = [0xF0F0 << 40 ^ 1 << rng.randrange(40) ^ 1 << rng.randrange(40) for _ in range(60)]
    values = sorted({*chain, *star, *(rng.getrandbits(62) for _ in range(30))})
    data = [(5 if i % 10 else 6, i, [v]) for i, v in enumerate(values)] + [(5, i, [v]) for i, v in enumerate(values) if i % 10 == 0]
    rows = spark.createDataFrame(data, "_key long, _id long, _words array<long>")
    links = [(r.a, r.b) for r in linked(rows, 2, block).distinct().collect()]
    assert all((values[a] ^ values[b]).bit_count() > 0 for a, b in links)
    reached = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert [reached.get(i, i) for i in range(len(values))] == brute_components(values, 2)


def test_a_hot_group_of_copies_meets_its_smallest_row_and_outsiders_meet_all(spark):
    """One component of most rows, a few outsiders that link only with each other or with one member."""
    rng = random.Random(4)
    hub = rng.getrandbits(62)
    near = {hub ^ 1 << rng.randrange(62) for _ in range(50)} | {hub ^ 1 << i ^ 1 << j for i, j in ((1, 2), (5, 9), (7, 30))}
    member = sorted(near)[3]
    outside = [member ^ 0b111 << 40 ^ 1 << 59, rng.getrandbits(62), rng.getrandbits(62)]
    outside += [outside[0] ^ 0b11 << 20, outside[1] ^ 1 << 3]
    values = [hub, *sorted(near - {hub}), *outside]
    rows = spark.createDataFrame([(1, i, [v]) for i, v in enumerate(values)], "_key long, _id long, _words array<long>")
    for block in (10, 4, 1):
        links = linked(rows, 2, block).distinct()
        reached = {r.node: r.label for r in components(links).collect()}
        assert [reached.get(i, i) for i in range(len(values))] == brute_components(values, 2)
    assert linked(rows.limit(0), 2, 3).count() == 0


def test_gray_neighbours_differ_in_one_bit():
    values = np.arange(64, dtype=np.uint64)
    ordered = values[np.argsort(gray_rank(values))]
    assert (np.bitwise_count(ordered[1:] ^ ordered[:-1]) == 1).all()


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(1, 50)] + [(7, 7), (300, 299)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{100 + i: 100 for i in range(50)}, 299: 299, 300: 299}


def test_near_copies_keep_one_of_each_group(spark, docs):
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    data, groups = [], 60
    for g in range(groups):
        words = random.choices(vocabulary, k=random.choice([40, 120, 400, 2000]))
        for k in range(4):
            changed = list(words)
            for at in random.sample(range(len(words)), max(1, len(words) // 110)) if k else ():
                changed[at] = "changed"
            data.append((g * 10 + k, " ".join(changed), g))
    got = {r.doc_id: r for r in near_copies(spark.createDataFrame(data, "doc_id long, text string, g int")).collect()}
    similar = linked = 0
    for i in range(0, len(data), 4):
        sets = [set(shingle_hashes(t, 5).tolist()) for _, t, _ in data[i : i + 4]]
        for k in (1, 2, 3):
            if len(sets[0] & sets[k]) >= 0.8 * len(sets[0] | sets[k]):
                similar += 1
                linked += got[data[i + k][0]].duplicate_of == data[i][0]
    assert similar > 120 and linked >= 0.97 * similar
    assert all(r.duplicate_of is None or r.duplicate_of // 10 == r.doc_id // 10 for r in got.values())
    assert all(not got[g * 10].is_copy for g in range(groups))
    edge = near_copies(docs).collect()
    stays = Counter(r.text for r in edge if not r.is_copy)
    assert len(edge) == docs.count() and max(stays.values()) == 1 and sum(r.text in (None, "") and not r.is_copy for r in edge) == 1
    assert near_copies(docs.limit(0)).count() == 0


def brute_copies(texts):
    """The label of each text: the first that it reaches by links of similarity 0.8 of five-word shingles."""
    sets = [set(shingle_hashes(t, 5).tolist()) for t in texts]
    label = list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if label[j] < label[i] and 5 * len(a & b) >= 4 * len(a | b):
                    label[i], changed = label[j], True
    return label


def copies_at(rng, shingles, similarity, tag):
    """Two texts of about so many shingles each whose sets have about the similarity."""
    words = [f"{tag}w{i}" for i in range(shingles + 4)]
    changed, k = list(words), 0
    sets = set(shingle_hashes(" ".join(words), 5).tolist())
    order = rng.permutation(len(words))
    while k < len(words):
        step = list(changed)
        step[order[k]] = f"{tag}x{k}"
        other = set(shingle_hashes(" ".join(step), 5).tolist())
        if len(sets & other) < similarity * len(sets | other):
            break
        changed, k = step, k + 1
    return " ".join(words), " ".join(changed)


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_near_copies_are_exactly_those_of_similarity_08(spark, monkeypatch, block):
    monkeypatch.setattr(simhash.similar, "__defaults__", (block,))
    rng, texts = np.random.default_rng(3), []
    for n in [*range(1, 13), 20, 39, 45, 48, 49, 55, 60, 61, 80, 100, 150, 200, 400] * 2:
        for s in (0.65, 0.75, 0.78, 0.80, 0.82):
            texts += copies_at(rng, n, s, f"{len(texts)}t")
        words = [f"{len(texts)}e{i}" for i in range(n + 4)]
        texts += [" ".join(words), " ".join([*words, *(f"{len(texts)}f{i}" for i in range(n // 4))])]
        texts.append(" ".join([*words, *(f"{len(texts)}g{i}" for i in range(n // 4 + 1))]))
    labels = brute_copies(texts)
    got = {r.doc_id: r.duplicate_of for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    want = {i: None if g == i else g for i, g in enumerate(labels)}
    assert sum(v is not None for v in want.values()) > 60
    assert {i: (len(texts[i].split()), got[i], want[i]) for i in want if got[i] != want[i]} == {}


def test_near_copies_count_a_repeated_shingle_once(spark):
    texts = []
    for g in range(20):
        words = [f"{g}r{i}" for i in range(300)]
        texts += [" ".join(words), " ".join(words + words[:100] * 3)]  # the same set but for the seams
    texts += [" ".join(["la"] * 400 + [f"{g}s{i}" for i in range(150)]) for g in range(6)]  # one shingle in common
    texts += ["la " * 50, "la " * 70]
    labels = brute_copies(texts)
    got = {r.doc_id: r.duplicate_of for r in near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: None if g == i else g for i, g in enumerate(labels)}
    assert [labels[i] for i in range(40)] == [i // 2 * 2 for i in range(40)] and labels[40:] == [*range(40, 46), 46, 46]


PAGES = [
    (1, "http://www.b.example/x", "<p>same</p>"), (5, "https://a.example/y?q=1", "<p>same</p>"), (3, "bad url\r\nX: y", "<p>same</p>"),
    (7, None, None), (8, "http://a.example/", ""), (9, "http://a.example/", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\nümlaut"),
    (10, "http://a.example/", "long \r\n\r\n" * 20000), (5, "https://a.example/y?q=1", "<p>same</p>"), (None, "u", "<p>same</p>"),
]


def test_archives_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_RECORDS", 2)
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, record_type string")
    got = warc.archived(pages).collect()
    want = Counter()
    for key, _, html in PAGES:
        data = (html or "").encode()
        same = [k for k, _, h in PAGES if (h or "") == (html or "") and k is not None]
        first = max(same, default=None)
        revisit = first is not None and (key is None or key < first)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want[key, len(data), digest, "revisit" if revisit else "response", first if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    order = [(r.url_key, r.captured_at, r.archive, r.place) for r in got]
    assert order == sorted(order)
    large = warc.archived(pages, least_bytes=1).where("page_id IN (7, 8)").collect()
    assert [r.record_type for r in large] == ["response", "response"]
    assert warc.archived(pages.limit(0)).count() == 0


def test_payloads_come_back_whole(spark):
    folder = warc.write_archives(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    found = {}
    for row in spark.read.format("binaryFile").load(folder).collect():
        for _, headers, block in warc.records(bytes(row.content)):
            if headers["WARC-Type"] == "response":
                found[headers["WARC-Record-ID"]] = block.partition(b"\r\n\r\n")[2].decode()
    assert found["<urn:page:9>"] == PAGES[5][2] and found["<urn:page:10>"] == PAGES[6][2]


@pytest.mark.parametrize("k", [0, 1, 2, 3, 5, 8, 13])
def test_loser_tree_merges(k):
    random.seed(k)
    runs = [sorted((str(random.randrange(30)), "t", 0, 0, 0, 0, 0, 0, f"r{i}", j, True) for j in range(random.randrange(9))) for i in range(k)]
    runs = [sorted(r, key=warc._order) for r in runs]
    assert list(warc.LoserTree([iter(r) for r in runs])) == sorted((e for r in runs for e in r), key=warc._order)


def test_url_keys():
    assert warc.url_key("https://www.News.Example.com:8080/A?b=C") == "com,example,news)/a?b=c"
    assert warc.url_key("https://www.a.example/b c") == warc.url_key("https://www.a.example/b%20c") == "example,a)/b c"
    assert warc.url_key("http://a.example/x\r\ny?q=%0A") == "example,a)/x\r\ny?q=\n"
    assert warc.url_key("") == ")/" and warc.url_key("http://[bad/") == "http://[bad/"


def test_read_back_measures_payloads(spark, tmp_path):
    """A changed byte shows in the response's digest and in every revisit of it."""
    pages = [(1, "u", "<p>abc</p>"), (2, "u", "<p>abc</p>"), (3, "v", "<p>other</p>"), (4, "v", None)]
    folder = warc.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"))
    before = warc.with_measured(warc.capture_runs(spark, folder)).collect()
    assert {r.page_id: r.intact for r in before} == {"1": True, "2": True, "3": True, "4": True}
    damaged = tmp_path / "archives"
    damaged.mkdir()
    for row in spark.read.format("binaryFile").load(folder).collect():
        (damaged / row.path.rpartition("/")[2]).write_bytes(bytes(row.content).replace(b"<p>abc", b"<p>abd"))
    after = {r.page_id: r for r in warc.with_measured(warc.capture_runs(spark, str(damaged))).collect()}
    assert {k: r.intact for k, r in after.items()} == {"1": False, "2": False, "3": True, "4": True}
    changed = base64.b32encode(hashlib.sha1(b"<p>abd</p>").digest()).decode()
    assert after["2"].payload_digest == after["1"].payload_digest == changed and after["1"].payload_bytes == 10


def test_any_key_and_url_comes_back(spark):
    pages = [("a b%20<c>", "https://www.a.example/b c"), ("line\r\nbreak", "https://a.example/x\ty"), ("", "u"), ("é+", None), (None, "u")]
    made = spark.createDataFrame([(k, u, "same") for k, u in pages], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.archived(made).collect()}
    assert set(got) == {k for k, _ in pages} and all(r.intact for r in got.values())
    assert got["a b%20<c>"].url_key == "example,a)/b c" and got["line\r\nbreak"].url_key == "example,a)/x\ty"
    assert {r.refers_to for r in got.values()} == {None, max(k for k, _ in pages if k is not None)}
