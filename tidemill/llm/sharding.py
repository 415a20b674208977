"""Shards of near equal bytes by histogram sort."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm._spark import table

#: Bits of the first key (of the text's hash) and of the second (the id).
BITS = (60, 64)
#: How many counts come to the driver from one pass, about.
PROBES = 1 << 16
#: Ranges of all shards together at most; in larger tables the ranges grow. High bits of a key that lead to its splitters.
RANGES, LEAD = 1 << 15, 12


@dataclass
class Splitter:
    """The edge nearest to target / scale bytes, as far as the probes have shown."""

    target: int
    slack: int
    scale: int
    prefix: tuple[int, int] = (0, 0)
    below: int = 0
    rows_below: int = 0
    found: bool = False


def _order_keys(text_col: str, id_col: str) -> tuple[Column, Column]:
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(text_col), F.lit("")).cast("binary")), 1, BITS[0] // 4), 16, 10).cast("long")
    return hashed, F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))


def find_splitters(keys: DataFrame, targets: list[tuple[int, int, int]]) -> list[Splitter]:
    """Refine probes until each splitter is known to within its slack of bytes.

    keys: columns k1, k2 and size. Each pass counts the bytes and rows below the probes inside
    all brackets still open, in one aggregation that sends no more than about PROBES counts; a
    bracket then shrinks to the probe interval that holds its target. A bracket of one row, or
    of rows alike in both keys, can't be cut further; its splitter stands at the nearer end.
    """
    splitters = [Splitter(*t) for t in targets]
    for level, bits in enumerate(BITS):
        done = 0
        while done < bits and (still := [s for s in splitters if not s.found]):
            brackets = {s.prefix for s in still}
            step = min(bits - done, max(1, (PROBES // len(brackets)).bit_length() - 1), 12)
            inside = keys
            if level == 0 and done:
                inside = keys.where(F.shiftright("k1", bits - done).isin([p[0] for p in brackets]))
            elif level == 1:
                inside = keys.where(F.col("k1").isin(sorted({p[0] for p in brackets})))
                if done:
                    inside = inside.where(F.concat_ws(":", "k1", F.shiftright("k2", bits - done)).isin(sorted(f"{a}:{b}" for a, b in brackets)))
            done += step
            probes = (F.shiftright("k1", bits - done), F.lit(0)) if level == 0 else (F.col("k1"), F.shiftright("k2", bits - done))
            counts = inside.groupBy(probes[0].alias("a"), probes[1].alias("b")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
            by_bracket: dict[tuple[int, int], list] = {p: [] for p in brackets}
            for r in sorted(counts):
                up = (r["a"] >> step, 0) if level == 0 else (r["a"], r["b"] >> step if done > step else 0)
                by_bracket[up].append(r)
            for s in still:
                for r in by_bracket[s.prefix]:
                    at = (r["a"], r["b"])
                    after = s.below + r["size"]
                    if after * s.scale <= s.target:
                        s.below, s.rows_below = after, s.rows_below + r["n"]
                        continue
                    s.prefix = at
                    whole = r["n"] == 1 or (level == 1 and done == bits)
                    if s.below * s.scale >= s.target - s.slack or (whole and (s.below + after) * s.scale >= 2 * s.target):
                        s.found = True
                    elif whole or after * s.scale <= s.target + s.slack:
                        s.below, s.rows_below, s.found = after, s.rows_below + r["n"], True
                        s.prefix = (at[0] + 1, 0) if level == 0 else (at[0], at[1] + 1)
                    if s.found:
                        left = bits - done
                        s.prefix = (s.prefix[0] << left, -(2**63)) if level == 0 else (s.prefix[0], s.prefix[1] << left)
                    break
    return splitters


def _fixed(values: list, kind: str) -> Column:
    """A list as one literal, however long."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")


def _ranges(k1: Column, k2: Column, splitters: list[Splitter]) -> Column:
    """How many splitters stand at or below a key: by the key's high bits, then among the few that share them."""
    high = [s.prefix[0] >> (BITS[0] - LEAD) for s in splitters]
    lead = [0] * ((1 << LEAD) + 2)
    for h in high:
        lead[h + 1] += 1
    for b in range(1, len(lead)):
        lead[b] += lead[b - 1]
    first = _fixed(lead, "int")
    every = _fixed([{"k1": s.prefix[0], "k2": min(s.prefix[1], 2**63 - 1)} for s in splitters], "struct<k1: bigint, k2: bigint>")
    own = F.shiftright(k1, BITS[0] - LEAD).cast("int")
    low, end = F.get(first, own), F.get(first, own + 1)
    key = F.struct(k1.alias("k1"), k2.alias("k2"))
    return low + F.size(F.filter(F.slice(every, low + 1, end - low), lambda s: s <= key))


def shard_by_bytes(docs: DataFrame, shards: int = 16, range_bytes: int = 16 << 20, slack: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with size, shard and slot: shards of near equal bytes, sorted by a hash of the text and then by id.

    A row's size is its text's UTF-8 bytes (null: none) plus 1. Shard i begins at the first
    row whose middle has i / shards of all bytes before it, so a shard is off its share by no
    more than half of the rows at its two edges (and slack bytes more). Equal texts stand together; one shard's edge may
    cut a group of them, which is how a group larger than a shard is spread. Rows alike in
    text and id are not parted. slot counts a shard's rows from 0 without gaps.

    Rows are exchanged once. A shard is sorted in ranges of about range_bytes (in tables of over RANGES
    of these, in as many ranges that grow with the table), whose edges come from the same counts, so a task never holds
    a whole shard of a large table. An empty table gives no rows. Columns of docs named size, shard or slot are replaced.
    """
    k1, k2 = _order_keys(text_col, id_col)
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 1
    keys = docs.select(k1.alias("k1"), k2.alias("k2"), size.alias("size")).persist()
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(RANGES // shards, -(-total // (shards * range_bytes))))
    count = shards * parts
    targets = [(total * i, slack * count if i % parts == 0 else total // 10, count) for i in range(1, count)]
    splitters = find_splitters(keys, targets) if total else []
    keys.unpersist()
    rows = _fixed([0, *(s.rows_below for s in splitters)], "bigint")
    plain = docs.drop("size", "shard", "slot", "k1__", "k2__", "range__").withColumns({"k1__": k1, "k2__": k2, "size": size})
    placed = plain.withColumn("range__", _ranges(F.col("k1__"), F.col("k2__"), splitters) if splitters else F.lit(0))
    first = (F.col("range__") / parts).cast("int")
    before = F.get(rows, F.col("range__")) - F.get(rows, first * parts)
    nth = F.row_number().over(Window.partitionBy("range__").orderBy("k1__", "k2__"))
    return placed.withColumn("slot", nth.cast("long") - 1 + before).withColumn("shard", first).drop("k1__", "k2__", "range__")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shard_by_bytes(table(spark, sf_dir, "documents"))
    return docs.select(
        "doc_id", "size", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


#: CRC-32 of a text in SQL: the table of its polynomial by rule, then one step a byte.
_CRC = """
crc AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
  CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i))),
"""

OP1_SQL = f"""
WITH {_CRC}
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS k FROM documents),
s AS (SELECT *, coalesce(sum(size) OVER (ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(size) OVER () AS total FROM d),
p AS (SELECT doc_id, text, size, k, ((16 * (2 * below + size)) // (2 * total))::INT AS shard FROM s)
SELECT doc_id, size::BIGINT AS size,
  xor(list_reduce(list_prepend(4294967295, list_transform(range(1, size), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::BIGINT)),
    lambda c, b: xor(c // 256, t[1 + xor(c % 256, b)])), 4294967295)::BIGINT AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM p, crc
"""
