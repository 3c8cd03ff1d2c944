"""SQL for the queries that SQL can express. The others are held against the tokenizer libraries or
brute force in tests/llm."""

from __future__ import annotations

from tessera.llm import feistel, url_filter

BLANKS = r"[\x20\x09-\x0D]+"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANKS}'), lambda w: w <> '')"


def _op2() -> str:
    """Every rule's expression against every URL: what the index must not change."""
    site = url_filter.SITE_RULES
    hits = ", ".join(f"CASE WHEN regexp_matches(host || path, '{r.pattern}') THEN {{'n': {len(r.name)}, 'name': '{r.name}', 'action': '{r.action}'}} END" for r in site)
    other = ", ".join(f"CASE WHEN regexp_matches(lowered, '{r.pattern}') THEN {{'action': '{r.action}', 'name': '{r.name}'}} END" for r in url_filter.PATTERN_RULES)
    upper = "".join(chr(c) for c in range(65, 91))
    return f"""WITH a AS (SELECT page_id, translate(coalesce(url, ''), '{upper}', '{upper.lower()}') AS lowered, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, lowered, translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{upper.lower()}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
c AS (SELECT *, list_max(list_filter([{hits}], lambda x: x IS NOT NULL)) AS s, list_min(list_filter([{other}], lambda x: x IS NOT NULL)) AS u FROM b)
SELECT page_id, host, path, s.name AS rule, coalesce(s.action, u.action, 'allow') AS verdict, u.name AS pattern FROM c"""


def _crc_step() -> str:
    """One byte's remainder for CRC-32: eight steps of a shift and a conditional polynomial."""
    x = "n"
    for _ in range(8):
        x = f"xor({x} >> 1, 3988292384::BIGINT * ({x} & 1))"
    return x


def _op5() -> str:
    """The Feistel rounds in arithmetic, cycle walking by recursion, the checksum by bytes."""
    mask = "((1::BIGINT << h.b) - 1)"
    rounds = f"SELECT w.number, (w.pos >> h.b) AS l, (w.pos & {mask}) AS r, h.b AS b FROM w, h WHERE NOT w.done"
    for key in feistel.round_keys():
        t = f"((r * 1103515245 + {key}) % 2147483648)"
        u = f"((xor({t}, {t} >> 15) * 1540483477) % 2147483648)"
        rounds = f"SELECT number, r AS l, xor(l, ({u} >> 5) & ((1::BIGINT << b) - 1)) AS r, b FROM ({rounds})"
    crc = "xor(list_reduce(list_transform(regexp_extract_all(hex(encode(n.t)), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, x: xor(c >> 8, v.t[(xor(c, x) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"
    return f"""WITH RECURSIVE v AS (SELECT list_transform(range(256), lambda n: {_crc_step()}) AS t),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, size, t, row_number() OVER (ORDER BY doc_id) - 1 AS number FROM d),
h AS (SELECT greatest(1, (length(bin(greatest(count(*) - 1, 1))) + 1) // 2)::BIGINT AS b, count(*)::BIGINT AS n FROM documents),
w(number, pos, done) AS (SELECT number, number, false FROM n UNION ALL SELECT number, (l << b) | r, ((l << b) | r) < (SELECT count(*) FROM documents) FROM ({rounds}))
SELECT n.doc_id, n.size::BIGINT AS size, {crc} AS text_crc32, 'rows' AS law, (w.pos % {feistel.SHARDS})::INTEGER AS shard, w.pos // {feistel.SHARDS} AS slot, NULL::INTEGER AS grown_shard, n.number FROM n JOIN w USING (number), v WHERE w.done"""


_OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w, row_number() OVER () AS k FROM documents),
i AS (SELECT k, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8), g AS (SELECT k, i, array_to_string(w[i:i + 7], ' ') AS x FROM i),
r AS (SELECT k, i, count(*) OVER (PARTITION BY k, x) AS c FROM g), p AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM r WHERE c > 1) GROUP BY k),
m AS (SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '{BLANKS}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) AS n_upper, list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '{BLANKS}', '', 'g')) > 0) AS l, coalesce(p.n, 0) AS n_repeat_words FROM d LEFT JOIN p USING (k)),
b AS (SELECT *, len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines FROM m),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 4 * n_symbols > n_words THEN 4 ELSE 0 END
+ CASE WHEN word_chars > 15 * n_words OR word_chars < 2 * n_words THEN 8 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END + CASE WHEN 2 * n_upper > word_chars THEN 32 ELSE 0 END)::BIGINT AS failed FROM b)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, failed & 3 <> 0 AS base_failed, failed = 0 AS kept, failed FROM f"""

ORACLES: dict[str, str] = {"op2_url_filter": _op2(), "op5_sharding": _op5(), "op7_quality_rules": _OP7}
