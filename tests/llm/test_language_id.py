"""Language identification: held-out accuracy, the nearest centroid by brute force, awkward rows."""

import collections
import math
import random
import zlib

import numpy as np
import pytest

from srcgraph.llm import language_id

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, score INT, lang_pred STRING"
WORDS = {
    "aa": "tion ing the ere of and nder thing", "bb": "éau çois ment leux ère que ouvi dé",
    "cc": "straße über nicht gehen lich unge schaft ein", "dd": "ñal ción mente los ado ura ist que"}


def documents(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        parts = WORDS[lang].split()
        text = " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60)))
        rows.append((i, text.capitalize() + f". {i}", lang, "s", len(text), 1, "clash"))
    return rows


AWKWARD = [
    (9001, None, "aa", None, None, None, None), (9002, "", None, None, None, None, None),
    (9003, "12 ½ ² _ -- !", "aa", None, None, None, None), (None, "über nicht gehen", "zz", None, None, None, None),
    (9004, "the of and " * 200_000, None, None, None, None, None), (9005, "漢字", None, None, None, None, None)]


def plain_counts(text):
    found = collections.Counter(text[i:i + k] for k in (1, 2, 3) for i in range(len(text) - k + 1))
    total = collections.Counter()
    for gram, n in found.items():
        run = 0
        for c in gram:
            run = (run * (0x10FFFF + 2) + ord(c) + 1) % 2 ** 64
        total[int(language_id.mix(np.array([run], dtype=np.uint64))[0]) % language_id.DIMS] += n
    return total


def test_accuracy_and_nearest_centroid(spark):
    rows = documents() + AWKWARD
    frame = spark.createDataFrame(rows, SCHEMA)
    model = language_id.fit_languages(frame)
    assert sorted(set(model["languages"])) == sorted(WORDS)
    assert len(model["languages"]) <= 4 * language_id.CLUSTERS
    assert np.allclose((model["centroids"] ** 2).sum(1), 1, atol=1e-5)
    got = {r.doc_id: r for r in language_id.identify_languages(frame, model).collect()}
    assert len(got) == len(rows)
    held = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert {i for i, r in got.items() if r.held_out} == {r[0] for r in held}
    right = [got[r[0]].lang_pred == r[2] for r in held if r[0] < 9000]
    assert sum(right) >= 0.97 * len(right)
    for i in (9001, 9002, 9003):
        assert (got[i].lang_pred, got[i].score, got[i].rejected) == ("und", 0.0, False)
    assert got[None].lang_pred == "cc" and got[9004].lang_pred == "aa"
    assert got[9005].lang_pred in WORDS and got[9005].rejected
    assert all(0 <= r.score <= 1 for r in got.values())

    # document frequencies over all training rows, and the nearest centroid, by dictionaries
    train = [r for r in rows if r[0] is not None and r[2] and r[1] and zlib.crc32(str(r[0]).encode()) % 4 != 2]
    kept = [c for c in (language_id.clean(r[1]) for r in train) if c]
    held_by = collections.Counter(place for text in kept for place in plain_counts(text))
    idf = np.array([math.log((1 + len(kept)) / (1 + held_by[i])) + 1 for i in range(language_id.DIMS)])
    assert np.allclose(idf, model["idf"])
    for r in held[:40]:
        text = language_id.clean(r[1])
        w = {p: (1 + math.log(n)) * idf[p] for p, n in plain_counts(text).items()}
        size = math.sqrt(sum(v * v for v in w.values())) or 1
        cosine = [sum(v * float(c[p]) for p, v in w.items()) / size for c in model["centroids"]]
        best = max(range(len(cosine)), key=cosine.__getitem__)
        assert got[r[0]].lang_pred == model["languages"][best] and abs(got[r[0]].score - cosine[best]) < 1e-5


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    rows = documents(120)
    changed = [(i, t, "zz" if zlib.crc32(str(i).encode()) % 4 == 2 else la, "other", 0, 0, "x") for i, t, la, *_ in rows]
    first, second = (
        sorted(map(tuple, language_id.identify_languages(f, language_id.fit_languages(f)).collect()))
        for f in (spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(changed, SCHEMA).repartition(3)))
    assert first == second


def test_empty_tables_and_repeated_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    model = language_id.fit_languages(none)
    assert language_id.identify_languages(none, model).count() == 0
    frame = spark.createDataFrame(documents(20), SCHEMA)
    assert {r.lang_pred for r in language_id.identify_languages(frame, model).collect()} == {"und"}
    copies = spark.createDataFrame(documents(30) + documents(30)[:1] * 900, SCHEMA)
    got = language_id.identify_languages(copies, language_id.fit_languages(copies)).collect()
    assert len(got) == 930 and len({(r.doc_id, r.lang_pred, r.score) for r in got}) == 30


def test_pieces_of_long_texts_count_like_the_whole(monkeypatch):
    text = language_id.clean("Straße über nicht gehen çois ment 12 leux " * 40)
    whole = language_id.counts(text)
    monkeypatch.setattr(language_id, "_PIECE", 17)
    parts = language_id.counts(text)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    assert dict(zip(*map(np.ndarray.tolist, whole), strict=True)) == plain_counts(text)


@pytest.mark.parametrize("text", ["", None, "42", "́", "---\n\t"])
def test_no_letter(text):
    assert language_id.clean(text) == ""
