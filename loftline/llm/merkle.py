"""Merkle manifest of a dataset by time-forward processing.

The nodes of a tree are labelled so that children come before their parent (by the last leaf below a node, then by
level) and are processed in that order; a digest is sent ahead to the parent through a priority queue ordered by label,
so that it is at hand when the parent's turn comes.  The reversed sweep starts at the root and sends each child its
proof suffix: the child's siblings, then what the parent was sent.

The queue is external in this sense: trees are cut into blocks of WIDTH**HEIGHT consecutive leaves, Spark's shuffle
sorts leaves by label and hands blocks to tasks, and the digests of block roots are sent ahead to the next round as rows.
A task holds one block and a queue of a few entries a level; no tree of any source stands in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loftline.llm.common import settled

#: Children of a node; levels that one block spans.
WIDTH, HEIGHT = 3, 8


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _runs(n: int, high: int | None) -> list[int]:
    """Nodes on each level over n leaves: up to one node, or up to level ``high`` where the tree goes on above."""
    out = [n]
    while len(out) <= high if high is not None else out[-1] > 1:
        out.append(-(-out[-1] // WIDTH))
    return out


def sweep_up(leaves: list[str], high: int | None) -> list[list[str]]:
    """Digests by level, nodes processed by label (last leaf below, level); the queue delivers children to parents."""
    size = _runs(len(leaves), high)
    nodes: list[list[str]] = [[] for _ in size]
    queue: list[tuple[int, int, int, str]] = []   # (last leaf below the receiver, its level, number of the child, digest)

    def done(level: int, k: int, value: str) -> None:
        nodes[level].append(value)
        if level + 1 < len(size):
            heappush(queue, (min(len(leaves), (k // WIDTH + 1) * WIDTH ** (level + 1)) - 1, level + 1, k, value))

    for k, leaf in enumerate(leaves):
        done(0, k, leaf)
        while queue and queue[0][0] <= k:   # the receiver's last leaf is in: its children stand at the front, in order
            at = queue[0][:2]
            children = []
            while queue and queue[0][:2] == at:
                children.append(heappop(queue)[2:])
            done(at[1], children[0][0] // WIDTH, digest(*[v for _, v in children]))
    return nodes


def sweep_down(nodes: list[list[str]], suffix: str) -> list[str]:
    """Each leaf's path to the top: a part for each level, ``left|right`` siblings, ended by ``;``, then the suffix given.

    Labels in reverse order; the queue delivers the parent's suffix to the children.
    """
    n, top = len(nodes[0]), len(nodes) - 1
    last = lambda level, k: min(n, (k + 1) * WIDTH ** level) - 1
    queue = [(-last(top, k), -top, -k, suffix) for k in range(len(nodes[top]))]
    out = [""] * n
    while queue:
        _, level, k, sent = heappop(queue)
        level, k = -level, -k
        if not level:
            out[k] = sent
            continue
        own = nodes[level - 1][k * WIDTH:(k + 1) * WIDTH]
        for i in range(len(own)):
            heappush(queue, (-last(level - 1, k * WIDTH + i), 1 - level, -(k * WIDTH + i), f"{''.join(own[:i])}|{''.join(own[i + 1:])};{sent}"))
    return out


def fold(leaf: str, path: str) -> str:
    """The root that a leaf and its path lead to."""
    for part in path.split(";")[:-1]:
        left, right = part.split("|")
        leaf = digest(left, leaf, right)
    return leaf


def siblings(path: str) -> str:
    """The sibling digests of a path in a row, level by level, left to right."""
    return path.replace("|", "").replace(";", "")


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """((key, block), its rows), a block at a time from sorted batches."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        at = list(zip(pdf["key"], pdf["block"]))
        cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1]], len(at)]
        for s, e in zip(cuts, cuts[1:]):
            if s == e:
                continue
            if held and (held[0]["key"].iloc[0], held[0]["block"].iloc[0]) != at[s]:
                whole = pd.concat(held)
                yield (whole["key"].iloc[0], whole["block"].iloc[0]), whole
                held = []
            held.append(pdf.iloc[s:e])
    if held:
        whole = pd.concat(held)
        yield (whole["key"].iloc[0], whole["block"].iloc[0]), whole


def _high(n: int, height: int) -> int | None:
    return height if n > WIDTH ** height else None


def _roots(nodes: DataFrame, height: int) -> DataFrame:
    """(key, pos, n, value): a row for each block with its top digest, the nodes of the next round."""
    def up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [(key, block, -(-int(b["n"].iloc[0]) // WIDTH ** height), sweep_up(b["value"].tolist(), _high(int(b["n"].iloc[0]), height))[-1][0]) for (key, block), b in _each(batches)]
        yield pd.DataFrame(rows, columns=["key", "pos", "n", "value"])
    dealt = nodes.select("key", F.expr(f"pos div {WIDTH ** height}").alias("block"), "pos", "n", "value").repartition("key", "block").sortWithinPartitions("key", "block", "pos")
    return dealt.mapInPandas(up, "key string, pos long, n long, value string")


def _sent(nodes: DataFrame, above: DataFrame, height: int, *extra: str) -> DataFrame:
    """Rows of nodes and, before each block's, the row of ``above`` (key, pos of the block, path, root) that was sent to it."""
    none = lambda c: F.lit(None).cast("string").alias(c)
    to = above.select("key", F.col("pos").alias("block"), F.lit(-1).cast("long").alias("pos"), F.lit(0).cast("long").alias("n"), none("value"), "path", "root", *[none(c) for c in extra])
    own = nodes.select("key", F.expr(f"pos div {WIDTH ** height}").alias("block"), "pos", "n", "value", none("path"), none("root"), *extra)
    return own.unionByName(to).repartition("key", "block").sortWithinPartitions("key", "block", "pos")


def _down(block: pd.DataFrame, height: int) -> tuple[pd.DataFrame, list[str], str]:
    """A block's own rows, their paths, and what was sent with the block's own path."""
    sent, own = block.iloc[0], block.iloc[1:]
    return own, sweep_down(sweep_up(own["value"].tolist(), _high(int(own["n"].iloc[0]), height)), sent["path"]), sent["root"]


def _paths(nodes: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """(key, pos, path, root) of nodes; ``above`` has the same of the blocks they stand in."""
    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for (key, _), block in _each(batches):
            own, paths, root = _down(block, height)
            yield pd.DataFrame({"key": key, "pos": own["pos"], "path": paths, "root": root})
    return _sent(nodes, above, height).mapInPandas(down, "key string, pos long, path string, root string")


def _leaf_paths(leaves: DataFrame, above: DataFrame, height: int) -> DataFrame:
    """As ``_paths`` for leaves with what they carry, the digest of the proof and the root that the claim folds to."""
    def down(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, block in _each(batches):
            own, paths, root = _down(block, height)
            yield pd.DataFrame({"carried": own["carried"], "leaf": own["value"], "subroot": root[64:], "root": root[:64], "path": paths,
                                "proof_sha256": [digest(siblings(p)) for p in paths], "folded_root": [fold(c, p) for c, p in zip(own["claim"], paths)]})
    return _sent(leaves, above, height, "claim", "carried").mapInPandas(
        down, "carried string, leaf string, subroot string, root string, path string, proof_sha256 string, folded_root string")


def _rounds(nodes: DataFrame, height: int) -> list[DataFrame]:
    """The nodes, then block roots, round after round, until each key has one row."""
    out = [nodes]
    while True:
        out.append(settled(_roots(out[-1], height)))
        if (out[-1].agg(F.max("n")).first()[0] or 1) <= 1:
            return out


def _placed(rows: DataFrame, order: list[str | Column], *keep: str) -> DataFrame:
    """Rows with ``pos`` (place in the key by ``order``) and ``n`` (rows of the key), whatever a key's size.

    The table is dealt by ranges of key and order, sorted and kept, so that a row's place in its part is fixed; the parts'
    sizes by key are then added up in order.
    """
    kept = settled(rows.repartitionByRange("key", *order).sortWithinPartitions("key", *order))
    kept = kept.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    sizes = kept.groupBy("key", "_part").agg(F.min("_m").alias("_low"), F.count(F.lit(1)).alias("_c"))
    over = Window.partitionBy("key")
    before = F.coalesce(F.sum("_c").over(over.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("key", "_part", (before - F.col("_low")).alias("_off"), F.sum("_c").over(over).alias("n"))
    return settled(kept.join(sizes, ["key", "_part"]).select("key", (F.col("_m") + F.col("_off")).alias("pos"), "n", *keep))


def leaf(*fields: str | Column) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    one = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    return F.sha2(F.concat(*[one((F.col(f) if isinstance(f, str) else f).cast("string")) for f in fields]), 256)


def manifest(leaves: DataFrame, group: str, order: str, leaf: str = "leaf", claim: str = "claim", keep: tuple[str, ...] = (), height: int = HEIGHT) -> DataFrame:
    """(leaf, subroot, root, path, proof_sha256, folded_root) of every row, and the columns in ``keep``.

    ``leaf`` and ``claim`` are digests: trees are built over the first, ``folded_root`` is where the second leads with the
    first one's siblings.  The leaves of a group stand by ``order`` (null first), then by leaf and claim; rows equal in all
    are interchangeable.  Groups stand null first, then bytewise.  A lone leaf is its group's subroot, a lone subroot the
    root.  ``path`` has the siblings on each level up to the root, see ``sweep_down``.  An empty table gives no rows.
    """
    carried = F.to_json(F.struct(*keep)) if keep else F.lit("{}")
    schema = leaves.select(*keep).schema
    rows = leaves.select(F.coalesce(F.concat(F.lit("g"), F.col(group).cast("string")), F.lit("")).alias("key"), F.col(order).alias("order"),
                         F.col(leaf).alias("value"), F.col(claim).alias("claim"), carried.alias("carried"))
    placed = _placed(rows, ["order", "value", "claim", F.rand(1)], "value", "claim", "carried")   # the last deals equal rows over tasks
    low = _rounds(placed, height)
    subroots = _placed(low[-1].select(F.lit("").alias("key"), F.col("key").alias("group"), "value"), ["group"], "group", "value")
    high = _rounds(subroots, height)
    sent = high[-1].select("key", "pos", F.lit("").alias("path"), F.col("value").alias("root"))
    for nodes in reversed(high[:-1]):
        sent = _paths(nodes, sent, height)
    sent = (sent.select("pos", "path", "root").join(subroots.select("pos", "group", "value"), "pos")
            .select(F.col("group").alias("key"), F.lit(0).cast("long").alias("pos"), "path", F.concat("root", "value").alias("root")))
    for nodes in reversed(low[1:-1]):
        sent = _paths(nodes, sent, height)
    out = _leaf_paths(placed, sent, height)
    return out.select(*[F.from_json("carried", schema)[c].alias(c) for c in keep], "leaf", "subroot", "root", "path", "proof_sha256", "folded_root")


def proven(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """(doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified) of every row.

    Rows whose decimal doc_id has an even CRC-32 are checked with their text's \\n characters deleted; a null doc_id or
    text stays.  The other columns of ``docs`` are not looked at.
    """
    cut = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = ["doc_id", "source", "lang", "n_chars"]
    leaves = docs.select("doc_id", "source", leaf(*fields, "text").alias("leaf"), leaf(*fields, cut).alias("claim"))
    return manifest(leaves, "source", "doc_id", keep=("doc_id",), height=height).withColumn("verified", F.col("folded_root") == F.col("root"))


#: Trees level by level as recursive tables; the CRC bit by bit.
ORACLE = """
WITH RECURSIVE f AS (SELECT doc_id, source, text,
    CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
    || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END AS head,
    list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)) AS crc FROM documents),
d AS (SELECT doc_id, source, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    CASE WHEN crc & 1 = 1 THEN replace(text, chr(10), '') ELSE text END AS cut, head FROM f),
l AS (SELECT doc_id, source, leaf, sha256(head || CASE WHEN cut IS NULL THEN '-' ELSE strlen(cut) || ':' || cut END) AS claim,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
low AS (SELECT source, 0 AS level, pos, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM l
    UNION ALL SELECT source, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM low WHERE n > 1 GROUP BY source, level, pos // 3, n),
s AS (SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM low WHERE n = 1),
high AS (SELECT 0 AS level, pos, subroot AS h, count(*) OVER () AS n FROM s
    UNION ALL SELECT level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (n + 2) // 3 FROM high WHERE n > 1 GROUP BY level, pos // 3, n),
steps AS (SELECT l.source, l.pos AS leaf_pos, low.level AS step, string_agg(low.h, '' ORDER BY low.pos) FILTER (low.pos < l.pos // CAST(pow(3, low.level) AS BIGINT)) AS lft,
        string_agg(low.h, '' ORDER BY low.pos) FILTER (low.pos > l.pos // CAST(pow(3, low.level) AS BIGINT)) AS rgt
      FROM l JOIN low ON l.source IS NOT DISTINCT FROM low.source AND low.n > 1 AND low.pos // 3 = l.pos // CAST(pow(3, low.level + 1) AS BIGINT) GROUP BY ALL
    UNION ALL
      SELECT l.source, l.pos, 1000 + high.level, string_agg(high.h, '' ORDER BY high.pos) FILTER (high.pos < s.pos // CAST(pow(3, high.level) AS BIGINT)),
        string_agg(high.h, '' ORDER BY high.pos) FILTER (high.pos > s.pos // CAST(pow(3, high.level) AS BIGINT))
      FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN high ON high.n > 1 AND high.pos // 3 = s.pos // CAST(pow(3, high.level + 1) AS BIGINT) GROUP BY ALL),
p AS (SELECT source, leaf_pos, string_agg(coalesce(lft, '') || coalesce(rgt, ''), '' ORDER BY step) AS proof,
        list(struct_pack(lft := coalesce(lft, ''), rgt := coalesce(rgt, '')) ORDER BY step) AS path FROM steps GROUP BY ALL),
e AS (SELECT l.source, l.pos, 1 AS i, l.claim AS h, p.path FROM l LEFT JOIN p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.leaf_pos
    UNION ALL SELECT source, pos, i + 1, sha256(path[i].lft || h || path[i].rgt), path FROM e WHERE i <= coalesce(len(path), 0))
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, e.h AS folded_root, e.h = r.h AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN high r ON r.n = 1 LEFT JOIN p ON l.source IS NOT DISTINCT FROM p.source AND l.pos = p.leaf_pos
JOIN e ON l.source IS NOT DISTINCT FROM e.source AND l.pos = e.pos AND e.i = coalesce(len(e.path), 0) + 1
"""
