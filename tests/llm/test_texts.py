"""Text operators on awkward rows, against plain Python."""

import collections
import hashlib
import random
import re
import time
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from srcgraph.llm import (
    extract_html, merkle, mixing, ngram_join, packing, passage_dedup, secrets, suffix_dedup, toxicity)
from srcgraph.llm.suffix_array import suffix_array

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, uid STRING, h INT, spans STRING"
WORD = re.compile("[^\x20\x09-\x0d]+")


def make_docs(spark, texts):
    """Documents with ids from 0, and columns whose names operators use inside."""
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, None if t is None else len(t), "u", 1, "x")
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def awkward_texts():
    rng = random.Random(3)
    vocabulary = [f"{a}{b}" for a in "abcdefghij" for b in ("n", "ö", "x1")]
    passage = " ".join(rng.choice(vocabulary) for _ in range(60))
    base = [rng.choice(vocabulary) for _ in range(120)]
    texts = [None, "", " \n\t", "one", "two words", "same text", "same text", "a " * 400, "a b c\x1cd"]
    for _ in range(25):
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = rng.choice(vocabulary)
        texts.append(" ".join(near))
    for _ in range(20):
        own = " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 150)))
        texts.append(own + "\n" + passage + "  " + own[:40])
    texts.append(" ".join(rng.choice(vocabulary) for _ in range(20_000)))
    texts += texts[10:14]
    return texts


@pytest.fixture(scope="module")
def texts():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    frame = make_docs(spark, texts)
    # rows that repeat wholly, and rows without an id
    return frame.union(frame.where("doc_id IN (5, 12)")).union(
        frame.where("doc_id IN (20, 45)").withColumn("doc_id", F.lit(None).cast("long")))


def rows_of(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    for _ in range(2000):
        s = [rng.randint(0, rng.choice((1, 2, 6))) for _ in range(rng.randint(0, 30))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def test_repeated_bytes(docs):
    rows = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    seen = collections.Counter(b[i:i + 200] for _, b in rows for i in range(len(b) - 199))
    want = collections.Counter()
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p:p + 200]] > 1:
                gone[p:p + 200] = b"\1" * 200
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.remove_repeats(docs).collect()
    assert collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0


def test_repeated_passages(docs):
    rows = [(i, WORD.findall(t or "")) for i, t in rows_of(docs)]
    first = {}
    for i, w in rows:
        for p in range(len(w) - 49 if i is not None else 0):
            key = tuple(w[p:p + 50])
            first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, w in rows:
        gone = [0] * len(w)
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p:p + 50])] < i:
                gone[p:p + 50] = [1] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    got = passage_dedup.remove_passages(docs).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r.n_removed for r in got) > 0


def shingles(text):
    lower = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(lower)
    return frozenset(tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def test_similar_documents(docs):
    rows = [(i, shingles(t)) for i, t in rows_of(docs)]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (_, x) in enumerate(rows):
        for b in range(a):
            y = rows[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                parent[root(a)] = root(b)
    want = collections.Counter()
    for a, (i, x) in enumerate(rows):
        ids = [rows[b][0] for b in range(len(rows)) if root(b) == root(a) and rows[b][0] is not None]
        want[i, len(x), min(ids) if ids and x else i] += 1
    # with groups as they are, and with every group dealt again under all orders
    for pairs in (ngram_join.PAIRS, 0):
        got = ngram_join.join_similar(docs, frequent=5, pairs=pairs).collect()
        assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    kept = ngram_join.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    empty = {i for i, x in rows if not x}
    assert {r.doc_id for r in kept.collect()} == {c for i, n, c in want if n} | empty


def test_sketches_differ_no_more_than_sets():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64))
        y = np.unique(rng.integers(0, 400, rng.integers(0, 300)).astype(np.uint64))
        apart = int(ngram_join.slots_apart(ngram_join.sketch(x), ngram_join.sketch(y)))
        assert apart <= len(np.setxor1d(x, y)) and (apart == 0 or not np.array_equal(x, y))


def test_secrets(docs, spark):
    key = "AKIA" + "Q" * 16
    text = f'x Password = "abcDEF123456" {key} {"0af" * 6} token: short api_key=ab/c+d=e_f.g-h1'
    found = make_docs(spark, [text, None, "my auth key: Zk39xQpL0vTt81Yw2sRb7NmC and more", "ſecret=abcdefghijklmn"])
    got = {r.doc_id: r for r in secrets.scan_secrets(found).collect()}
    a = text.index("Password"), text.index('" AKIA')
    k, h = text.index(key), text.index("0af0af")
    t = text.index("api_key")
    base = f"assign:{a[0]}:{a[1]},access:{k}:{k + 20},hex:{h}:{h + 18},assign:{t}:{len(text)}"
    assert (got[0].n_assign, got[0].n_access, got[0].n_hex) == (2, 1, 1)
    assert got[0].base_sha256 == hashlib.sha256(base.encode()).hexdigest() and got[0].spans == base
    assert got[1].spans == "" and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[2].spans == "novel:13:37" and got[2].n_novel == 1
    assert got[3].n_assign == 0  # only ASCII letters fold
    assert secrets.scan_secrets(docs).count() == docs.count()
    clean = secrets.redact_secrets(found).orderBy("doc_id").collect()
    assert key not in clean[0].text and clean[0].n_chars == len(clean[0].text) and clean[1].text is None


def test_merkle(docs):
    rows = rows_of(docs.where("doc_id IS NOT NULL").distinct())
    rows.sort(key=lambda r: r[0])
    got = {r.doc_id: r for r in merkle.merkle_fingerprints(docs.where("doc_id IS NOT NULL").distinct()).collect()}
    for at, (i, t) in enumerate(rows):
        t, n = t or "", rows[(at + 1) % len(rows)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + n[:half]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[i].near_next <= 1 and (got[i].near_edited == 1) >= (edited == t)
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (edited == t)
    same = collections.defaultdict(set)
    for i, t in rows:
        same[t or ""].add(got[i].fingerprint)
    assert all(len(v) == 1 for v in same.values())
    assert len({f.split("/")[0] for v in same.values() for f in v}) == len(same)
    assert merkle.merkle_fingerprints(docs).count() == docs.count()
    alone = merkle.merkle_fingerprints(docs.where("doc_id = 12").limit(1)).first()
    text = dict(rows)[12]
    half = len(text) // 2
    assert alone.edited_sha256 == hashlib.sha256((text[:len(text) - half] + text[:half]).encode()).hexdigest()


def test_next_document_of_distant_ids(spark):
    for low, high in ((0, 2 ** 60), (-2 ** 62 - 5, 2 ** 62 + 5), (-2 ** 63, 2 ** 63 - 1)):
        rows = [(low, "abcd"), (low + 1, "efgh"), (high, "ijkl")]
        got = {r.doc_id: r.edited_sha256 for r in merkle.merkle_fingerprints(
            spark.createDataFrame(rows, "doc_id LONG, text STRING")).collect()}
        assert got == {i: hashlib.sha256(t).hexdigest() for i, t in ((low, b"abef"), (low + 1, b"efij"), (high, b"ijab"))}


def test_targets():
    # plain water filling, source by source
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 450 / 3 + 50 / 3, 250 / 3])
    got = mixing.targets([10, 1000, 0, 50, 7])
    assert sum(got) == pytest.approx(1.5 * 1067) and got[2] == 0
    assert all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 0, 50, 7], strict=True))
    assert mixing.targets([]) == []


def test_mix(docs):
    got = mixing.mix_sources(docs).collect()
    assert len(got) == docs.count()
    again = mixing.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = collections.defaultdict(list)
    sources = {r.doc_id: r.source for r in docs.collect()}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by[sources[r.doc_id] if r.doc_id is not None else "?"].append(r)
    for name, rows in by.items():
        if name != "?" and not any(sources[r.doc_id] is None for r in rows):
            assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows) * 2
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(mixing.word_count())).first()[0]
    assert words == pytest.approx(sum(r.taken for r in got), rel=0.1)
    assert mixed.where("n_chars <> length(text)").count() == 0


def test_split_tree_deals_exact_quotas():
    tree = mixing.SplitTree([50, 30, 7], 5, 1)
    dealt = [(s, tree.shard(s, i)) for s, q in enumerate((50, 30, 7)) for i in range(q)]
    sizes = collections.Counter(x for _, x in dealt)
    assert set(sizes) == set(range(5)) and max(sizes.values()) - min(sizes.values()) <= 3
    for s in range(3):  # a shard's blocks of a source are one run
        order = [x for q, x in dealt if q == s]
        assert order == sorted(order)


def test_packing(docs):
    capacity = 50
    got = packing.pack_documents(docs, capacity, group_rows=40).collect()
    want = [len(WORD.findall(t or "")) for _, t in rows_of(docs)]
    assert sum(r.n_words for r in got) == sum(want)
    assert len(got) == sum(max(1, -(-n // capacity)) for n in want)
    bins = collections.defaultdict(list)
    text = dict(rows_of(docs))
    for r in got:
        bins[r.pack_group, r.bin].append(r)
    for rows in bins.values():
        assert sum(r.n_words for r in rows) <= capacity and {r.bin_words for r in rows} == {sum(r.n_words for r in rows)}
        own = [text[r.doc_id] for r in rows if r.doc_id is not None]
        assert len(own) == len(set(own))  # no copies in one bin
    # the tightest bin that is compatible, not the tightest
    assert packing.pack([7, 6, 3], [0, 1, 2], [5, 6, 5], 10, 1.0) == [0, 1, 1]


def test_toxicity(spark):
    rng = random.Random(5)
    words = [f"w{i}x" for i in range(80)]
    texts, labels = [], []
    for i in range(400):
        bad = i % 5 == 0
        w = [rng.choice(words) for _ in range(rng.randint(5, 40))]
        if bad:
            w[rng.randrange(len(w))] = rng.choice(("grumpf", "bläh", "grуmpf", "grumpfig"))
        texts.append(" ".join(w))
        labels.append((i, 1 if bad else 0))
    frame = make_docs(spark, [*texts, None, "", "GRUMPF!! you", "some pond grumpf here"])
    marks = spark.createDataFrame([*labels, (401, None), (None, 1)], "doc_id LONG, toxic INT")
    model = toxicity.fit_lexicon(frame, marks)
    got = {r.doc_id: r for r in toxicity.score_toxicity(frame, model, ("pond grumpf",)).collect()}
    assert len(got) == 404 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    assert got[400].score == got[401].score < 0.5 and got[402].predicted == 1
    assert got[403].predicted == 0  # the exception phrase
    kept = toxicity.drop_toxic(frame, model)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted} - {403}
    nothing = toxicity.fit_lexicon(frame, marks.limit(0))
    assert {r.score for r in toxicity.score_toxicity(frame, nothing).collect()} == {0.0}
    assert toxicity.drop_toxic(frame, nothing).count() == 404


def test_folding():
    assert toxicity.fold("Idi0t  $tupid іdiot​").split() == ["idiot", "stupid", "idiot"]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a><li><a href="/x">X</a></ul></nav>
<div class="notice">We use cookies &amp; more</div><div class="ad">Buy now</div>
%s
<aside>Related</aside><form><p>Sign up</p><input></form><div id="comments"><p>First! A long comment by a reader
that goes on and on and on.</p></div><footer>&copy; me</footer></body></html>"""


@pytest.mark.parametrize("wrap", ["<article>%s</article>", "<main>%s</main>", "<div class='content'>%s</div>"])
def test_main_text(wrap):
    body = ("<h1>A  title</h1><p>First <b>bold</b>&nbsp;paragraph, long enough to be text &lt;here&gt;.<br>After a break"
            "<p>Second paragraph\n with a line end and more words in it.</p><p>Short.</p><!-- no -->")
    got = extract_html.main_text(PAGE % (wrap % body))
    assert got == ("A title\nFirst bold paragraph, long enough to be text <here>.\nAfter a break\n"
                   "Second paragraph with a line end and more words in it.\nShort.")


LEAD = "A lead that is one sentence of ordinary prose and stands before the story itself, as leads do."
STORY = "".join(f"<p>Paragraph {i} of the story is ordinary running prose, long enough to be told from menus.</p>" for i in range(4))
NOTE = "This legal note is long and dense prose as well, but it stands in a block of its own beside the story."


@pytest.mark.parametrize("head, story", [
    ("<h1>Headline</h1><p>%s</p>" % LEAD, "<article>%s<p>End.</p></article>"),
    ("", "<main><h1>Headline</h1><p>%s</p>%%s<p>End.</p></main>" % LEAD),
    ("", "<div><h1>Headline</h1><p>%s</p>%%s<p>End.</p></div>" % LEAD)])
def test_unmarked_places(head, story):
    page = ("<html><body><div>Site name</div><div><a href=a>Home</a> <a href=b>Cart</a></div>" + head + story % STORY
            + "<div><h4>Most read</h4><ul><li><a href=c>One other story</a><li><a href=d>And one more</a></ul></div>"
            + f"<div><p>{NOTE}</p></div></body></html>")
    lines = extract_html.main_text(page).split("\n")
    assert lines[:2] == ["Headline", LEAD] and lines[-1] == "End." and len(lines) == 7


def test_one_long_block_hides_nothing():
    page = f"<body><div>Site</div><div>{STORY * 5}<pre>{'code line ' * 2000}</pre>{STORY}<ul><li>short<li>list</ul></div></body>"
    lines = extract_html.main_text(page).split("\n")
    assert len(lines) == 27 and lines[-2:] == ["short", "list"]
    parts = f"<body><div>{STORY}</div><div>{STORY}</div></body>"
    assert len(extract_html.main_text(parts).split("\n")) == 8


def test_long_pages_without_end_tags():
    table = "<table>" + "".join(f"<tr><td>cell {i}<td>more {i}" for i in range(40_000)) + "</table>"
    start = time.perf_counter()
    tracemalloc.start()
    assert extract_html.main_text("<main>" + "<li>one item" * 20_000 + "<font>x" * 20_000).count("\n") == 20_000 - 1
    assert len(extract_html.main_text(table).split("\n")) == 80_000
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.stop()
    assert time.perf_counter() - start < 60


def test_pages(spark):
    rows = [(1, "u", PAGE % "<article><p>Text</article>"), (2, None, None), (3, "u", ""), (None, "u", "<p>a</p>" * 3000),
            (3, "u", ""), (4, "u", "<<<>>&#x110000;&bogus; <p")]
    pages = spark.createDataFrame(rows, "page_id LONG, url STRING, html STRING").withColumn("text", F.lit("clash"))
    got = extract_html.extract_main_text(pages).collect()
    assert len(got) == 6 and all(r.n_chars == len(r.text) for r in got)
    assert {r.page_id: r.text for r in got if r.page_id in (1, 2, 3)} == {1: "Text", 2: "", 3: ""}
    assert extract_html.extract_main_text(pages.limit(0)).count() == 0


def test_empty_tables(docs):
    none = docs.limit(0)
    for frame in (suffix_dedup.remove_repeats(none), passage_dedup.remove_passages(none), ngram_join.join_similar(none),
                  ngram_join.keep_one_of_each(none), secrets.scan_secrets(none), merkle.merkle_fingerprints(none),
                  mixing.mix_sources(none), mixing.mixed_documents(none), packing.pack_documents(none)):
        assert frame.count() == 0
