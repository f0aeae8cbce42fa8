"""The Merkle manifest against a plain construction."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from srcgraph.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, more=0):
    doc_id, source, lang, n_chars, text = row
    n_chars = None if n_chars is None else n_chars + more
    out = ""
    for v in (doc_id, source, lang, n_chars, text):
        out += "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(out)


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([h(*below[i:i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 2 * 2
        out.append(([level[run]] if at != run else [], level[run + 1:run + 2] if at == run else []))
        at //= 2
    return out


def plain(rows):
    by = {}
    for row in rows:
        by.setdefault(row[2], []).append(row)
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees, orders = {}, {}
    for lang in langs:
        orders[lang] = sorted(by[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = plain_tree([leaf(r) for r in orders[lang]])
    top = plain_tree([trees[x][-1][0] for x in langs])
    out = []
    for at_lang, lang in enumerate(langs):
        for at, row in enumerate(orders[lang]):
            steps = siblings(trees[lang], at) + siblings(top, at_lang)
            changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1 if changed else 0)
            for left, right in steps:
                node = h(*left, node, *right)
            out.append((row[0], leaf(row), trees[lang][-1][0], top[-1][0],
                        h(*[x for left, right in steps for x in left + right]), node, node == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id LONG, source STRING, lang STRING, n_chars LONG, text STRING"


def run(spark, rows, height=manifest.BLOCK_LEVELS):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("key", F.lit(1)).withColumn("pos", F.lit("x"))
    return sorted(map(tuple, manifest.verify_manifest(frame, height).collect()), key=str)


@pytest.mark.parametrize("height", [2, 3, 10])
def test_against_plain_construction(spark, height):
    rows = [(i * 3 - 40, f"s{i % 4}", ["en", "de", None, "ünï", "z"][i % 5 if i % 3 else 0], i, f"text {i} ä" * (i % 7))
            for i in range(101)]
    rows += [(500, "s", "one", 1, "alone"), (14, None, None, None, None), (14, None, None, None, "same id"),
             (None, "a", "en", None, ""), (None, "a", "en", None, ""), (None, "b", "de", 3, "x" * 300_000)]
    got = run(spark, rows, height)
    assert got == plain(rows)
    assert 0 < sum(not r[-1] for r in got) < 40


def test_small_tables(spark):
    assert run(spark, []) == []
    for rows in ([(7, None, None, None, None)], [(1, "s", "en", 2, "a"), (2, "s", "en", 2, "b")],
                 [(1, "s", "en", 2, "a"), (2, "s", "de", 2, "b"), (3, "s", "fr", 1, "c")]):
        assert run(spark, rows) == plain(rows)


def test_repeated_rows(spark):
    rows = [(5, "s", "en", 3, "abc")] * 2500 + [(i, "s", "en", 3, "abc") for i in range(20)]
    assert run(spark, rows) == plain(rows)


def test_versions_share_untouched_nodes(spark):
    rows = [(i, "s", "en", i, f"t{i}") for i in range(40)]
    got = manifest.merkle_manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    tree = plain_tree([leaf(r) for r in rows])
    for r in got:
        assert len(r.copies) == len(r.siblings) == len(tree) - 1
        own = [level[r.pos >> (k + 1)] for k, level in enumerate(tree[1:])]
        # an unchanged leaf gives the original path; a version differs in every node of its path
        assert (r.copies == own) if r.changed is None else all(a != b for a, b in zip(r.copies, own, strict=True))
