"""The manifest against a plain recursive tree, and its SQL."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from loftline.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, value string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(*fields):
    return h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def plain_tree(leaves):
    """(root, siblings by leaf as lists of (left, right))."""
    paths, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(level) > 1:
        for k, p in enumerate(at):
            run = level[p // 3 * 3:p // 3 * 3 + 3]
            paths[k].append(("".join(run[:p % 3]), "".join(run[p % 3 + 1:])))
        level, at = [h(*level[i:i + 3]) for i in range(0, len(level), 3)], [p // 3 for p in at]
    return level[0], paths


def plain(rows):
    groups = defaultdict(list)
    for i, text, lang, source, n, _ in rows:
        cut = text.replace("\n", "") if text is not None and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else text
        groups[source].append((i, plain_leaf(i, source, lang, n, text), plain_leaf(i, source, lang, n, cut)))
    sources = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    trees = [plain_tree([r[1] for r in groups[s]]) for s in sources]
    root, above = plain_tree([t[0] for t in trees])
    out = []
    for s, (sub, paths), up in zip(sources, trees, above):
        for (i, leaf, claim), path in zip(groups[s], paths):
            steps = path + up
            end = claim
            for left, right in steps:
                end = h(left, end, right)
            out.append((i, leaf, sub, root, h(*[a + b for a, b in steps]), end, end == root))
    return out


def rows_of(sizes):
    rows, i = [], 0
    for source, n in sizes:
        for _ in range(n):
            i += 1
            rows.append((i * 7 % 1009, None if i % 11 == 0 else f"lïne {i % 5}\nnext" if i % 3 else "plain", None if i % 7 == 0 else "en", source, None if i % 13 == 0 else i, "x"))
    return rows


ODD = [(None, None, None, None, None, "x"), (None, "a\nb", "en", "s", 3, "x"), (None, "a\nb", "en", "s", 3, "x"), (5, "", "", "", 0, "x"), (5, "", "", "", 0, "x"), (5, "other\n", "", "", 0, "x"), (-3, "\n" * 2000, "en", "g", 1, "x")]


@pytest.mark.parametrize("height", [1, 2, 8])
@pytest.mark.parametrize("sizes", [[("b", 1)], [("b", 28), (None, 10), ("a", 9), ("é", 3), ("z", 1)], [(f"s{k}", 2) for k in range(31)]])
def test_manifest_equals_plain(spark, height, sizes):
    rows = rows_of(sizes) + ODD
    got = merkle.proven(spark.createDataFrame(rows, SCHEMA).repartition(3), height)
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in got.drop("path").collect()), key=key) == sorted(plain(rows), key=key)
    for r in got.collect():
        assert merkle.fold(r.leaf, r.path) == r.root and h(merkle.siblings(r.path)) == r.proof_sha256


def test_empty_table(spark):
    assert merkle.proven(spark.createDataFrame([], SCHEMA)).count() == 0
