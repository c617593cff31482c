"""op11: Merkle manifest over every row of `documents`, each leaf climbed to the root."""

from pyspark.sql import functions as F

from linkloom.llm.common import table
from linkloom.llm.merkle import manifest
from linkloom.llm.registry import register

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars")) + " || {0})"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# crc32 of an id's digits: table-free, eight shifts a byte
_CRC = ("xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(doc_id::VARCHAR) + 1), "
        "lambda i: ascii(substr(doc_id::VARCHAR, i, 1))::BIGINT)), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], "
        "lambda x, z: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT)")
LEVELS = 6  # 16^6 rows a group


def _climb(prev: str, name: str, n: int) -> str:
    """CTEs ``name1``..``name{n}``: nodes of each level, and proof and hash of the leaves below."""
    out = []
    for k in range(n):
        here = prev if k == 0 else f"{name}{k}"
        out.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT g, pos // 16 AS pos, (cnt + 15) // 16 AS cnt,
         CASE WHEN cnt = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h,
         list({{'pos': pos, 'h': h}} ORDER BY pos) AS kids, max(cnt) AS below FROM {here} GROUP BY g, pos // 16, cnt)""")
    return ",\n".join(out)


def _fold(h: str, level: str, pos: str) -> str:
    """Hash ``h`` at position ``pos`` folded into its parent row ``level``."""
    return (f"CASE WHEN {level}.below = 1 THEN {h} ELSE sha256(array_to_string(list_transform({level}.kids, "
            f"lambda k: CASE WHEN k.pos = {pos} THEN {h} ELSE k.h END), '')) END")


def _beside(level: str, pos: str) -> str:
    return (f"array_to_string(list_transform(list_filter({level}.kids, lambda k: k.pos <> {pos}), lambda k: k.h), '')")


def _walk(start: str, name: str, levels: str, n: int) -> str:
    out = []
    for k in range(n):
        here = start if k == 0 else f"{name}{k}"
        lv = f"{levels}{k + 1}"
        out.append(f"""{name}{k + 1} AS (SELECT w.id, w.rn, w.g0, w.g, w.pos // 16 AS pos, {_fold('w.f', lv, 'w.pos')} AS f,
  w.proof || {_beside(lv, 'w.pos')} AS proof FROM {here} w JOIN {lv} ON {lv}.g = w.g AND {lv}.pos = w.pos // 16)""")
    return ",\n".join(out)


SQL = f"""
WITH d AS (SELECT doc_id, source, {_LEAF.format(_FIELD.format('text'))} AS leaf,
             CASE WHEN coalesce({_CRC} % 5 = 0, false) THEN {_LEAF.format(_FIELD.format(_LOWER))} END AS bad,
             row_number() OVER () AS rn FROM documents),
gs AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS g FROM (SELECT DISTINCT source FROM d)),
l AS MATERIALIZED (SELECT d.*, g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf, rn) - 1 AS pos,
             count(*) OVER (PARTITION BY g) AS cnt FROM d JOIN gs ON gs.source IS NOT DISTINCT FROM d.source),
t0 AS MATERIALIZED (SELECT g, pos, cnt, leaf AS h FROM l),
{_climb('t0', 't', LEVELS)},
u0 AS MATERIALIZED (SELECT 0 AS g, g AS pos, count(*) OVER () AS cnt, h FROM t{LEVELS}),
{_climb('u0', 'u', LEVELS)},
w0 AS (SELECT doc_id AS id, rn, g AS g0, g, pos, coalesce(bad, leaf) AS f, '' AS proof FROM l),
{_walk('w0', 'w', 't', LEVELS)},
v0 AS (SELECT id, rn, g0, 0 AS g, g AS pos, f, proof FROM w{LEVELS}),
{_walk('v0', 'v', 'u', LEVELS)}
SELECT v.id AS doc_id, l.leaf, s.h AS subroot, r.h AS root, sha256(v.proof) AS proof_sha256, v.f AS folded_root, v.f = r.h AS verified
FROM v{LEVELS} v JOIN l ON l.rn = v.rn JOIN u0 s ON s.pos = v.g0 CROSS JOIN u{LEVELS} r
"""


@register("op11_merkle_manifest", SQL)
def op11_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
