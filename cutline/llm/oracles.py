"""SQL for operators whose rounds and levels are written out one after the other."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """Of each byte, the remainder that the checksum of zlib adds for it."""
    made = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        made.append(c)
    return made


def crc32(bytes_of: str) -> str:
    """The unsigned checksum of a list of bytes."""
    return f"xor(list_reduce({bytes_of}, lambda c, b: xor(c >> 8, {_crc_table()}[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295)"


#: The UTF-8 bytes of a text, null being empty, and of a whole number.
TEXT_BYTES = "list_transform(regexp_extract_all(hex(encode(coalesce({0}, ''))), '..'), lambda x: ('0x' || x)::BIGINT)"
DIGITS = "list_transform(string_split({0}::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"


def hilbert_sharding(dims: tuple[str, ...] = ("source", "lang", "n_chars"), bits: int = 5, shards: int = 24) -> str:
    n = len(dims)
    steps = [f"d AS MATERIALIZED (SELECT doc_id, {', '.join(dims)}, octet_length(encode(coalesce(text, ''))) + 8 AS size, {crc32(TEXT_BYTES.format('text'))} AS text_crc32 FROM documents)"]
    for i, dim in enumerate(dims):
        steps.append(f"v{i} AS (SELECT {dim} AS v, ((2 * (sum(count(*)) OVER (ORDER BY {dim} NULLS FIRST) - count(*)) + count(*)) * {1 << bits} // (2 * sum(count(*)) OVER ()))::BIGINT AS x{i} FROM d GROUP BY {dim})")
    joins = " ".join(f"JOIN v{i} ON d.{dim} IS NOT DISTINCT FROM v{i}.v" for i, dim in enumerate(dims))
    steps.append(f"s0 AS (SELECT d.*, {', '.join(f'x{i}' for i in range(n))} FROM d {joins})")
    at = 0
    for b in range(bits - 1, 0, -1):
        for i in range(n):
            low, on = (1 << b) - 1, f"x{i} & {1 << b} <> 0"
            swap = f"(xor(x0, x{i}) & {low})"
            new = [f"CASE WHEN {on} THEN xor(x0, {low}) ELSE xor(x0, {swap}) END AS x0"]
            if i:
                new.append(f"CASE WHEN {on} THEN x{i} ELSE xor(x{i}, {swap}) END AS x{i}")
            steps.append(f"s{at + 1} AS (SELECT * REPLACE ({', '.join(new)}) FROM s{at})")
            at += 1
    for i in range(1, n):
        steps.append(f"s{at + 1} AS (SELECT * REPLACE (xor(x{i}, x{i - 1}) AS x{i}) FROM s{at})")
        at += 1
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN x{n - 1} & {1 << b} <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    steps.append(f"f AS (SELECT *, {flip} AS t FROM s{at})")
    terms = [f"((xor(x{i}, t) >> {b} & 1) << {n * b + n - 1 - i})" for b in range(bits) for i in range(n)]
    steps.append(f"r AS (SELECT *, row_number() OVER (ORDER BY {' + '.join(terms)}, doc_id NULLS FIRST, size, text_crc32) - 1 AS place, count(*) OVER () AS total FROM f)")
    return f"WITH {', '.join(steps)} SELECT doc_id, size, text_crc32, 'rows' AS law, (place * {shards} // total)::INT AS shard, place - ((place * {shards} // total) * total + {shards - 1}) // {shards} AS slot, NULL::INT AS grown_shard, {', '.join(dims)} FROM r"


def vector_codes(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    steps = [
        "whole AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rn, vec_id, label, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM whole WHERE len(embedding) = (SELECT len(embedding) FROM whole WHERE vec_id IS NOT NULL ORDER BY vec_id, embedding LIMIT 1))",
        f"pieces AS MATERIALIZED (SELECT rn, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS u FROM kept, range({parts}) t(p))",
        f"b0 AS MATERIALIZED (SELECT p, rn - 1 AS e, u AS c FROM pieces WHERE rn <= {entries})",
    ]
    assigned = "SELECT rn, p, any_value(u) AS u, min({'d': list_sum(list_transform(list_zip(u, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'e': e}) AS m FROM pieces JOIN b%d USING (p) GROUP BY rn, p"
    for k in range(rounds):
        steps.append(f"a{k} AS MATERIALIZED ({assigned % k})")
        steps.append(f"m{k} AS (SELECT p, m.e AS e, i, sum(u[i])::BIGINT AS s, count(*) AS n FROM a{k}, unnest(range(1, len(u) + 1)) t(i) GROUP BY ALL)")
        steps.append(f"c{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM m{k} GROUP BY p, e)")
        steps.append(f"b{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(c{k}.c, b{k}.c) AS c FROM b{k} LEFT JOIN c{k} USING (p, e))")
    steps.append(f"a{rounds} AS MATERIALIZED ({assigned % rounds})")
    steps.append(f"coded AS (SELECT rn, string_agg(lpad(lower(hex(m.e)), 2, '0'), '' ORDER BY p) AS code, sum(m.d)::BIGINT AS error FROM a{rounds} GROUP BY rn)")
    steps.append(f"sha AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})")
    return f"WITH {', '.join(steps)} SELECT vec_id, label, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rn), sha"


def _levels(name: str, leaves: str, depth: int, fanout: int) -> list[str]:
    """Levels 1 to depth over `leaves`(g, ix, n, h)."""
    made = [f"{name}0 AS MATERIALIZED (SELECT *, NULL::VARCHAR[] AS ch FROM ({leaves}))"]
    for k in range(depth):
        made.append(f"{name}{k + 1} AS MATERIALIZED (SELECT g, ix // {fanout} AS ix, (n + {fanout - 1}) // {fanout} AS n, sha256(string_agg(h, '' ORDER BY ix)) AS h, list(h ORDER BY ix) AS ch FROM {name}{k} WHERE n > 1 GROUP BY g, ix // {fanout}, n)")
    return made


def _climb(name: str, start: str, levels: str, depth: int, fanout: int) -> list[str]:
    """From `start`(..., g, ix, fold, sib) up all levels: folds the hash and adds the siblings."""
    made = [f"{name}0 AS ({start})"]
    for k in range(depth):
        left, right = f"array_to_string(p.ch[1 : w.ix % {fanout}], '')", f"array_to_string(p.ch[w.ix % {fanout} + 2 : ], '')"
        made.append(f"{name}{k + 1} AS MATERIALIZED (SELECT w.* REPLACE (CASE WHEN p.g IS NULL THEN fold ELSE sha256({left} || fold || {right}) END AS fold, CASE WHEN p.g IS NULL THEN sib ELSE sib || {left} || {right} END AS sib, w.ix // {fanout} AS ix) FROM {name}{k} w LEFT JOIN {levels}{k + 1} p ON p.g = w.g AND p.ix = w.ix // {fanout})")
    return made


def merkle_manifest(depth: int = 14, upper: int = 4, fanout: int = 3) -> str:
    """For groups of up to fanout ** depth rows and up to fanout ** upper groups."""
    told = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(told(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    even = f"doc_id IS NOT NULL AND {crc32(DIGITS.format('doc_id'))} % 2 = 0"
    tops = " UNION ALL ".join(f"SELECT g, h FROM l{k} WHERE n = 1" for k in range(depth + 1))
    steps = [
        f"rows AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {leaf('text')} AS h, {leaf(f'''(CASE WHEN {even} THEN replace(text, chr(10), '') ELSE text END)''')} AS found FROM documents)",
        "leaves AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS ix, count(*) OVER (PARTITION BY g) AS n FROM rows)",
        *_levels("l", "SELECT g, ix, n, h FROM leaves", depth, fanout),
        f"tops AS MATERIALIZED ({tops})",
        *_levels("u", "SELECT 0 AS g, row_number() OVER (ORDER BY g) - 1 AS ix, count(*) OVER () AS n, h FROM tops", upper, fanout),
        f"root AS ({' UNION ALL '.join(f'SELECT h AS root FROM u{k} WHERE n = 1' for k in range(upper + 1))})",
        *_climb("w", "SELECT doc_id, h AS leaf, g, ix, found AS fold, '' AS sib FROM leaves", "l", depth, fanout),
        f"heads AS (SELECT w.* REPLACE (0 AS g, t.ix AS ix), t.h AS subroot FROM w{depth} w JOIN (SELECT g AS of, h, row_number() OVER (ORDER BY g) - 1 AS ix FROM tops) t ON w.g = t.of)",
        *_climb("z", "SELECT * FROM heads", "u", upper, fanout),
    ]
    return f"WITH {', '.join(steps)} SELECT doc_id, leaf, subroot, root, sha256(sib) AS proof_sha256, fold AS folded_root, fold = root AS verified FROM z{upper}, root"
