import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest

from leadsift.llm import decontaminate as dc
from leadsift.llm import secrets as se
from leadsift.llm import toxicity as tx
from leadsift.llm.extraction import extracted, main_text
from leadsift.llm.quality import quality
from leadsift.llm.suffixes import difference_cover, repeated_strings


def brute_hits(text, items, width=10):
    words = dc.words_of(text or "")
    hit, owners = set(), set()
    for item, item_text in items:
        iw = dc.words_of(item_text or "")
        windows = {tuple(iw[i : i + width]) for i in range(max(1, len(iw) - width + 1))} if iw else set()
        for w in windows:
            for i in range(len(words) - len(w) + 1):
                if tuple(words[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    owners.add(str(item))
    return len(words), len(hit), ",".join(sorted(owners))


@pytest.mark.parametrize("block_words", [2_000_000, 5])
def test_decontamination_equals_brute_force(spark, docs, rows, monkeypatch, block_words):
    monkeypatch.setattr(dc, "BROADCAST_WORDS", block_words)
    items = [(1, "over the LAZY dog while nine other animals look on and wonder the quick"), (2, "one"), (3, None), (4, ""), (5, "über öl")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.n_words, r.n_hit, r.items_sha256, r.contaminated) for r in dc.decontamination(docs, bench).collect())
    want = Counter()
    for _, text, _ in rows:
        n, hit, joined = brute_hits(text, items)
        want[n, hit, hashlib.sha256(joined.encode()).hexdigest(), hit > 0] += 1
    assert got == want
    clean = dc.without_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(v for k, v in want.items() if not k[3])
    assert dc.decontamination(docs.limit(0), bench).count() == 0
    assert not dc.decontamination(docs, bench.limit(0)).where("contaminated").count()


def test_secret_base_spans_equal_plain_patterns(docs, rows):
    pattern = {
        0: r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
        1: r"AKIA[A-Z0-9]+", 2: r"[0-9a-f]+",
    }
    extra = ["token=abc secret=token:abcdefgh", "APIKEY : 'abcdef'", "x" * 30 + "AKIA" + "A" * 30, "feed" * 5 + "F", "ſecret=abcdefg"]
    for text in [r[1] or "" for r in rows] + extra:
        want = []
        for k, p in pattern.items():
            for m in re.finditer(p, text, re.ASCII):
                if (k == 0 and len(m[1]) >= 6) or (k == 1 and len(m[0]) >= 20) or (k == 2 and len(m[0]) >= 24):
                    want.append((m.start(), k, m.end()))
        assert [s for s in se.spans_of(text) if s[1] < 3] == sorted(want), text
    got = se.secret_spans(docs).collect()
    assert len(got) == len(rows) and next(r for r in got if r.doc_id == 9).n_entropy == 1
    assert se.secret_spans(docs.limit(0)).count() == 0
    assert "hunter2" not in se.redacted(rows[9][1])


def test_window_entropy_equals_direct_sums():
    text = "aaaaaaaaaaaaaaaaaaaaaaaaZx9Qw3Er7Ty1Ui5Op8As2Df4Gh6aaaaaaaaaaaaaaaaaaaaaaaaa"
    covered = set()
    for i in range(len(text) - 19):
        n = Counter(text[i : i + 20])
        if -sum(c / 20 * math.log2(c / 20) for c in n.values()) >= 4.0 - 1e-9:
            covered |= set(range(i, i + 20))
    got = {p for a, b in se.high_windows(text, 20, 4.0) for p in range(a, b)}
    assert got == covered and covered
    assert not se.spans_of("123e4567-e89b-12d3-a456-426614174000 some-long-path-like-name_here " + "k" * 40)


def test_toxicity_on_held_out_rows(spark, docs):
    bad, good = ["idiot", "scum", "moron"], ["tree", "river", "stone", "cloud", "grass"]
    data = [(i, f"{good[i % 5]} {good[i * 7 % 5]} and the {bad[i % 3] + 'xyz'[i % 3] if i % 4 == 0 else good[i * 3 % 5]} word{i}") for i in range(400)]
    made = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    got = tx.toxicity(made, labels).collect()
    held = [r for r in got if r.held_out]
    assert len(got) == 400 and 40 < len(held) < 120
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out_id(), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    assert {(r.doc_id, r.score) for r in tx.toxicity(made, flipped).collect()} == {(r.doc_id, r.score) for r in got}
    edge = tx.toxicity(docs, labels).collect()
    assert len(edge) == docs.count() and all(0 <= r.score <= 1 for r in edge)
    assert all(r.score == 0 for r in tx.toxicity(docs, labels.limit(0)).collect())
    assert tx.toxicity(docs.limit(0), labels).count() == 0


def brute_repeats(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("length", [200, 400])
def test_repeated_strings_equal_brute_force(spark, docs, rows, length):
    got = Counter((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeated_strings(docs, length).collect())
    assert got == brute_repeats([r[1] for r in rows], length)
    assert repeated_strings(docs.limit(0)).count() == 0


def test_difference_cover_covers():
    for q in (2, 3, 5, 7, 13):
        v, d = q * q + q + 1, difference_cover(q)
        assert len(d) == q + 1 and {(a - b) % v for a in d for b in d} == set(range(v))


def test_quality_counts_and_shared_lines(spark, docs, rows):
    got = quality(docs, keep_text=True).collect()
    assert Counter(r.text for r in got) == Counter(r[1] for r in rows)
    for r in got:
        text = r.text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
        again = {p for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for p in range(i, i + 5)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        want = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(words) < 10 or 100 * len(again) > 20 * len(words))
    assert quality(docs.limit(0)).count() == 0
    body = "each document has {0} its own sentence number {0} with plenty of different words in it {0}"
    many = [(i, body.format("q" * (i + 1)) + "\nShare this Page 12!", "h") for i in range(30)]
    many += [(100 + i, f"Share this page  {i}\nshare THIS page, 7\nnow and here are words to count {'x' * i}", "h") for i in range(3)]
    many += [(200, "Share this page 1\n" + body.format("other"), "other host")]
    found = {r.doc_id: r for r in quality(spark.createDataFrame(many, "doc_id long, text string, source string"), keep_text=True).collect()}
    assert found[3].removed_lines == 1 and found[3].kept and "Share" not in found[3].clean_text
    assert found[101].removed_lines == 2 and not found[101].kept
    assert found[200].removed_lines == 0 and found[200].kept


def test_main_text_of_pages(spark):
    article = "<h1>A title</h1><p>One, two; three. Four &amp; five\n six.</p><p>Short.</p>"
    page = f'<html><head><title>t</title><script>x="<p>no</p>"</script></head><body><nav><a>Home</a></nav><div class="ad">Buy.</div>{{}}<footer>&copy;</footer></body>'
    want = "A title One, two; three. Four & five six. Short."
    assert main_text(page.format(f"<article>{article}</article>")) == want
    assert main_text(page.format(f'<div id="content">{article}<div class="comments"><p>Nice, really. Yes!</p></div></div><div class="sidebar"><p>More.</p></div>')) == want
    assert main_text(page.format(f"<article><p><b>{article}</article>")) == want
    pages = [(1, "u", page.format(f"<main>{article}</main>"), "old"), (2, None, None, None), (2, None, "", None), (None, "u", "<p", None), (4, "u", "<p>" + "long, text. " * 20000, None)]
    got = extracted(spark.createDataFrame(pages, "page_id long, url string, html string, text string")).collect()
    assert [r.text for r in got][:3] == [want, "", ""] and all(r.n_chars == len(r.text) for r in got) and got[4].n_chars == 239_999
    assert extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_rejected_tag_paths_leave_the_container():
    """Own labelled pages without names on what is beside the article: text to keep, text to lose."""
    para = "<p>A sentence {0} of the article, with commas, and a full stop. It goes on for a while, as articles do.</p>"
    body = "".join(para.format(i) for i in range(4))
    links = "<ul>" + "".join(f"<li><a href='{i}'>Page {i}</a></li>" for i in range(8)) + "</ul>"
    pages = [
        (f"<body>{links}<div><h1>Head</h1>{body}</div></body>", ["Head", "A sentence 3"], ["Page"]),
        (f"<main><div>We use cookies.</div><h1>Head</h1>{body}<h2>End</h2><p>Short.</p><div>First comment, nice.</div></main>",
         ["Head A sentence 0", "End Short."], ["cookies", "comment"]),
        (f"<article><h1>Head</h1>{body}<ul><li>one</li><li>two</li></ul><section><h3>3 replies</h3><div>Nice.</div></section></article>",
         ["Head", "do. one two"], ["replies", "Nice"]),
        (f"<article><header><h1>Head</h1><div>Sub</div></header>{body}<div>Between.</div>{body}{links}</article>",
         ["Head", "Between."], ["Page"]),
        (f"<main><section><h2><a href='x'>Linked head</a></h2>{body}</section><section><h2>Conclusion</h2><p>Brief.</p></section></main>",
         ["Linked head", "Conclusion Brief."], []),
        ("<article><h1>Head</h1><p>Brief.</p></article>", ["Head Brief."], []),
    ]
    for page, keep, lose in pages:
        text = main_text(page)
        assert all(k in text for k in keep) and not any(x in text for x in lose), text


def test_pages_in_a_wrapper_or_without_head_end_keep_their_article():
    body = "<h1>A title</h1>" + "".join(f"<p>Sentence {i}, which is long enough, says one thing; then another.</p>" for i in range(6))
    want = main_text(f"<html><body><div>{body}</div></body></html>")
    assert want.startswith("A title Sentence 0") and want.endswith("another.")
    aside = "<div class='sidebar'><p>Beside the text, a few words.</p></div>"
    assert main_text(f"<html><head><title>t</title><meta charset=utf-8><body><div>{body}</div></body></html>") == want
    for name in ("content with-sidebar", "no-sidebar", "layout sidebar-right"):
        assert main_text(f"<html><body><div class='{name}'><div>{body}</div>{aside}</div></body></html>") == want
    assert main_text(f"<html><body><form action='x.aspx'>{aside}<div>{body}</div></form></body></html>") == want
    for attrs in ("title='the hidden valley'", "onclick='toggleHidden(hidden)'", "data-hidden='false'"):
        assert main_text(f"<html><body><div {attrs}>{body}</div></body></html>") == want
    assert main_text(f"<html><body><div hidden>{body}</div></body></html>") == ""
    comments = "<div class='comments'>" + "<p>I think so too, and will say it at length, again and again.</p>" * 40 + "</div>"
    assert main_text(f"<html><body><article>{body}</article>{comments}</body></html>") == want


def brute_passages(texts, words):
    split = [(t or "").encode().split() for t in texts]
    holders = {}
    for i, w in enumerate(split):
        for k in range(len(w) - words + 1):
            holders.setdefault(tuple(w[k : k + words]), set()).add(i)
    out = []
    for w in split:
        inside = [False] * len(w)
        for k in range(len(w) - words + 1):
            if len(holders[tuple(w[k : k + words])]) > 1:
                inside[k : k + words] = [True] * words
        out.append(sum(inside))
    return out


def test_passages_of_words_equal_brute_force(spark, rows):
    """Passages shorter than the byte rule's strings; those of one text alone do not count."""
    rng = np.random.default_rng(11)

    def prose(n):
        return [f"w{x}" for x in rng.integers(0, 400, n)]

    shared = [prose(n) for n in (50, 51, 55, 61, 90)]
    texts = [r[1] for r in rows]
    for i in range(40):
        head, tail = prose(int(rng.integers(0, 60))), prose(int(rng.integers(0, 60)))
        texts.append(("\n" if i % 3 else "  ").join([*head, *shared[i % 5], *tail]))
    texts += [" ".join(prose(30) + shared[1]) + " x", "  " + " ".join(prose(51) * 2), "a " * 300, " ".join(f"solo{i}" for i in range(60)) + " z"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_passage_words for r in repeated_strings(made).collect()}
    assert got == dict(enumerate(brute_passages(texts, 51)))
    assert len({i for i, n in got.items() if n and i >= len(rows)}) >= 32


ALPHABETS = {
    "hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "lower": "abcdefghijklmnopqrstuvwxyz0123456789",
    "base62": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}


@pytest.mark.parametrize("name", ALPHABETS)
def test_random_tokens_are_found(name):
    rng = np.random.default_rng(1)
    for length, least in ((24, 0.85), (32, 0.95), (40, 0.97)):
        tokens = ["".join(rng.choice(list(ALPHABETS[name]), length)) for _ in range(400)]
        found = sum(bool(se.spans_of(f"the key is {t} now")) for t in tokens)
        assert found >= least * 400, (name, length, found)


def test_planted_keys_are_found_and_names_are_not():
    rng = np.random.default_rng(2)
    keys = ["sk_live_" + "".join(rng.choice(list(ALPHABETS["base62"]), 24)) for _ in range(200)]
    assert sum(any(k == 3 for _, k, _ in se.spans_of(t)) for t in keys) >= 190
    for text in (
        "https://example.com/some/long/path/with-many-words/2021/introduction", "internationalisation_of_measurements", "123456789012345678901234567890",
        "getUserByNameAndPlaceOfResidence", "550e8400-e29b-41d4-a716-446655440000", "CHAPTER12INTRODUCTION", "aaaaaaaaaaaaaaaaaaaaaaaaaa", "====================",
    ):
        assert not [s for s in se.spans_of(text) if s[1] == 3], text


def test_threshold_is_that_of_random_windows():
    rng = np.random.default_rng(3)
    for alphabet in (16, 36, 62):
        draws = rng.integers(0, alphabet, (4000, 20))
        bits = [-sum(c / 20 * math.log2(c / 20) for c in Counter(d).values()) for d in draws.tolist()]
        assert abs(np.mean(bits) - se.MARGIN * np.std(bits) - se.threshold(alphabet)) < 0.02
