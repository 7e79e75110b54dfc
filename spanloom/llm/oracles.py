"""DuckDB SQL for the queries of the training-data operators that SQL can express on whole tables."""

from __future__ import annotations

from . import chat_format, mixing
from .quality_rules import MAX_REPEAT_PERCENT, MIN_WORDS, RULES, STOP_WORDS, SYMBOLS

_SPACE = r"[\x20\x09-\x0D]"
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{_SPACE}+'), lambda x: x <> '')"


def _linked_sets(words: int, percent: int, result: str) -> str:
    """Components of documents whose sets of shingles are alike."""
    return f"""WITH RECURSIVE w AS (SELECT doc_id, {_words(f"translate(coalesce(text, ''), '{_AZ}', '{_az}')")} AS w FROM documents),
g AS (SELECT doc_id, CASE WHEN len(w) >= {words} THEN list_distinct(list_transform(generate_series(1, len(w) - {words - 1}), lambda i: array_to_string(w[i:i + {words - 1}], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM w),
s AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * c >= {percent} * (na + nb - c)),
r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT b, m FROM r JOIN l ON a = d),
c AS (SELECT d, min(m) AS component_id FROM r GROUP BY 1)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, {result} FROM g JOIN c ON d = doc_id"""


NEAR_DUPLICATES = _linked_sets(4, 80, "component_id, doc_id = component_id AS kept")
NGRAM_JOIN = _linked_sets(3, 90, "component_id")


def _collocations(least: int = 100, top: int = 2000, longest: int = 5) -> str:
    grams = " UNION ALL ".join(
        f"SELECT lang, array_to_string(w[i:i + {k - 1}], ' ') AS p, {k} AS k, count(*) AS f FROM (SELECT lang, w, unnest(generate_series(1, len(w) - {k - 1})) AS i FROM x) GROUP BY ALL" for k in range(1, longest + 1)
    )
    return f"""WITH t AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{_AZ}', '{_az}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
x AS (SELECT lang, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS w FROM t),
f AS (SELECT * FROM ({grams}) WHERE f >= {least}), n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM x GROUP BY 1),
c AS (SELECT lang, p, k, f AS a, string_split(p, ' ') AS w FROM f WHERE k > 1),
m AS (SELECT lang, unnest([array_to_string(w[2:], ' '), array_to_string(w[:k - 1], ' ')]) AS p, a FROM c WHERE k > 2),
d AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.lang = c.lang AND m.p = c.p AND 100 * m.a >= 100 * c.a)),
u AS (SELECT *, unnest(generate_series(1, k - 1)) AS j FROM d),
s AS (SELECT u.lang, u.p, a, j, l.f AS l, r.f AS r, n.n, CAST(1000 * CAST(a AS HUGEINT) * n.n // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM u JOIN f l ON l.lang = u.lang AND l.p = array_to_string(u.w[:j], ' ')
  JOIN f r ON r.lang = u.lang AND r.p = array_to_string(u.w[j + 1:], ' ') JOIN n ON n.lang = u.lang),
b AS (SELECT *, row_number() OVER (PARTITION BY lang, p ORDER BY score, j) AS i FROM s),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r, n, score FROM b WHERE i = 1)
SELECT * FROM o WHERE rank <= {top}"""


COLLOCATIONS = _collocations()


def _verdict() -> str:
    parts = []
    for r in RULES:
        if r.low is not None:
            parts.append(f"{r.numerator} * 1000 >= {r.denominator} * {r.low}")
        if r.high is not None:
            parts.append(f"{r.numerator} * 1000 <= {r.denominator} * {r.high}")
    return " AND ".join(parts)


_STOP = ", ".join(f"'{v}'" for w in sorted(set(STOP_WORDS)) for v in (w, w.capitalize()))
QUALITY_RULES = f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text, {_words("coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM documents),
i AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t), v AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM i),
d AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM v), k AS (SELECT DISTINCT doc_id, unnest([i, i + 1, i + 2]) AS p FROM d WHERE n > 1), r AS (SELECT doc_id, count(*) AS n FROM k GROUP BY 1),
m AS (SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words, CAST(len(list_intersect(w, [{_STOP}])) AS BIGINT) AS n_stop_kinds, length(text) - length(translate(text, '{_AZ}', '')) AS n_upper, 1 AS one FROM t LEFT JOIN r ON r.doc_id = t.doc_id),
b AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_verdict()} AS kept FROM b"""

_B, _M, _S = mixing.BLOCK, mixing.MOST, mixing.SEED


def _seats(src: str, keys: str, group: str, votes: str, seats: str, name: str, out: str) -> str:
    """CTEs for an apportionment by highest quotients around the quotas."""
    return f"""{out}1 AS (SELECT *, CASE WHEN sum({votes}) OVER (PARTITION BY {group}) > 0 THEN {votes} * {seats} / CAST(sum({votes}) OVER (PARTITION BY {group}) AS DOUBLE) ELSE 0 END AS q FROM {src}),
{out}2 AS (SELECT *, CAST(greatest(floor(q) - 12, 0) AS BIGINT) AS base FROM {out}1), {out}3 AS (SELECT *, CAST({seats} - sum(base) OVER (PARTITION BY {group}) AS BIGINT) AS rest FROM {out}2),
{out}4 AS (SELECT *, unnest(generate_series(base + 1, base + 25)) AS k FROM {out}3), {out}5 AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {votes} / CAST(2 * k - 1 AS DOUBLE) DESC, {keys}, k) AS rn FROM {out}4),
{out} AS (SELECT * EXCLUDE (q, base, rest, k, rn), CAST(max(base) + count(*) FILTER (rn <= rest AND {votes} > 0) AS BIGINT) AS {name} FROM {out}5 GROUP BY ALL)"""


SOURCE_MIXING = f"""WITH d AS (SELECT doc_id, source IS NULL AS n1, coalesce(source, '') AS n2, CAST(len({_words("coalesce(text, '')")}) AS BIGINT) AS size, ('0x' || md5('{_S}:' || coalesce(CAST(doc_id AS VARCHAR), 'null'))[1:15])::BIGINT AS h FROM documents),
s AS (SELECT n1, n2, CAST(sum(size) AS BIGINT) AS source_size, CAST(least(ceil(count(*) / {mixing.SHARD_DOCS}.0), {mixing.MAX_SHARDS}) AS BIGINT) AS n_shards FROM d GROUP BY 1, 2),
w AS (SELECT *, (row_number() OVER (ORDER BY n1, encode(n2)) - 1) % 3 + 1 AS weight FROM s),
l AS (SELECT *, ((sum(source_size) OVER () - coalesce(sum(source_size * {_M}) OVER o, 0)) / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS DOUBLE)) AS level, coalesce(sum(weight) OVER o, 0) AS before FROM w WINDOW o AS (ORDER BY source_size * {_M} / CAST(weight AS DOUBLE), n1, n2 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, source_size * {_M} / CAST(weight AS DOUBLE) < level AS stops FROM l), y AS (SELECT (SELECT level FROM x WHERE NOT stops ORDER BY before LIMIT 1) AS shared),
a AS (SELECT n1, n2, source_size, n_shards, CASE WHEN stops THEN CAST(source_size * {_M} AS DOUBLE) ELSE weight * shared END AS target FROM x, y),
g AS (SELECT *, CAST(floor(sum(target) OVER () / {_B} + 0.5) AS BIGINT) AS blocks, 0 AS one FROM a), {_seats("g", "n1, n2", "one", "target", "blocks", "source_blocks", "z")},
e AS (SELECT d.*, source_size, target, source_blocks, h % n_shards AS shard FROM d JOIN z ON d.n1 = z.n1 AND d.n2 = z.n2),
f AS (SELECT n1, n2, shard, source_blocks, CAST(sum(size) AS BIGINT) AS shard_size FROM e GROUP BY 1, 2, 3, 4), {_seats("f", "shard", "n1, n2", "shard_size", "source_blocks", "shard_blocks", "p")},
u AS (SELECT e.*, shard_size, shard_blocks, CAST(sum(size) OVER (PARTITION BY e.n1, e.n2, e.shard ORDER BY h, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fin, CAST(greatest(ceil(shard_size / {_B}.0), 1) AS BIGINT) AS n FROM e JOIN p ON e.n1 = p.n1 AND e.n2 = p.n2 AND e.shard = p.shard),
v AS (SELECT *, least(shard_blocks, {_M} * n) // n AS passes, least(shard_blocks, {_M} * n) % n AS rest, ('0x' || md5('{_S}:' || n1 || ':' || n2 || ':' || shard)[1:15])::BIGINT % n AS first FROM u)
SELECT doc_id, size, source_size, target, CAST(passes * size + greatest(least(fin, least((first + rest) * {_B}, shard_size)) - greatest(fin - size, first * {_B}), 0) + greatest(least(fin, (first + rest - n) * {_B}) - greatest(fin - size, 0), 0) AS BIGINT) AS taken FROM v"""

_O, _C = chat_format.OPEN, chat_format.CLOSE.strip()


def _render(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda t: '{_O}' || t.role || chr(10) || t.text || '{_C}' || chr(10)), '')"


def _mask(turns: str) -> str:
    before = f"coalesce(list_sum(list_transform({turns}[1:i - 1], lambda t: {len(_O) + len(_C) + 2} + length(t.role) + length(t.text))), 0) + {len(_O) + 1} + length({turns}[i].role)"
    span = f"CAST(CAST({before} AS BIGINT) AS VARCHAR) || '-' || CAST(CAST({before} + length({turns}[i].text) + {len(_C) + 1} AS BIGINT) AS VARCHAR)"
    return f"array_to_string(list_transform(list_filter(generate_series(1, len({turns})), lambda i: {turns}[i].role = 'assistant'), lambda i: {span}), ',')"


PREFERENCE_FORMAT = f"""WITH u AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'user') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY turn, role, text) AS turns FROM u GROUP BY 1),
w AS (SELECT conv_id, turns, coalesce(list_sum(list_transform(list_filter(turns, lambda t: t.role = 'assistant'), lambda t: len({_words("t.text")}))), 0) AS words, turns[1:greatest(coalesce(list_position(list_transform(turns, lambda t: t.role), 'user'), 0), 1)] AS opening FROM c),
b AS (SELECT opening, arg_min(conv_id, (-words, conv_id)) AS best, count(*) AS n FROM w GROUP BY 1),
h AS (SELECT b.opening, best, n, turns AS chosen FROM b JOIN w ON conv_id = best),
s AS (SELECT conv_id AS pair_id, best AS chosen_id, conv_id AS rejected_id, chosen, turns AS rejected FROM w JOIN h ON w.opening = h.opening AND n > 1 AND conv_id <> best),
l AS (SELECT *, list_max(list_filter(generate_series(1, len(chosen)), lambda i: chosen[i].role = 'assistant')) AS last FROM h WHERE n = 1),
p AS (SELECT * FROM s UNION ALL SELECT best, best, NULL, chosen, list_concat(chosen[1:last - 1], [struct_pack(role := 'assistant', text := '')]) FROM l WHERE last IS NOT NULL),
k AS (SELECT *, least(least(len(chosen), len(rejected)) - 1, coalesce(list_filter(generate_series(1, least(len(chosen), len(rejected))), lambda i: chosen[i] <> rejected[i])[1] - 1, len(chosen))) AS n FROM p),
x AS (SELECT *, chosen[1:n] AS shared, chosen[n + 1:] AS cc, rejected[n + 1:] AS rr FROM k)
SELECT pair_id, chosen_id, rejected_id, CAST(n AS BIGINT) AS n_shared, {_render("shared")} AS prompt, {_render("cc")} AS chosen_completion, {_mask("cc")} AS chosen_mask, {_render("rr")} AS rejected_completion, {_mask("rr")} AS rejected_mask FROM x"""

ORACLES: dict[str, str] = {
    "op7_preference_format": PREFERENCE_FORMAT,
    "op4_near_duplicates": NEAR_DUPLICATES,
    "op8_quality_rules": QUALITY_RULES,
    "op10_source_mixing": SOURCE_MIXING,
    "op11_ngram_join": NGRAM_JOIN,
    "op12_collocations": COLLOCATIONS,
}
