"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from tallygrid.llm.quality import LINE_LIMIT, MIN_WORDS, REPEAT_LIMITS, TOP_LIMITS
from tallygrid.llm.secrets import BASE, RULES

_WORD = r"[^\x20\x09-\x0D]+"


def _real(x: float) -> str:
    return f"CAST({x} AS DOUBLE)"


def quality_sql() -> str:
    """Exact n-grams as joined words; covered words by distinct places."""
    docs = f"""docs AS MATERIALIZED (SELECT doc_id, text, words, len(words) AS n_words,
  coalesce(list_sum(list_transform(words, lambda w: length(w))), 0) AS word_chars,
  list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines
FROM (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents) d)"""
    ctes, columns = [docs], []
    for n in sorted({3, *TOP_LIMITS, *REPEAT_LIMITS}):
        ctes.append(
            f"g{n} AS (SELECT doc_id, i, array_to_string(words[i:i + {n - 1}], ' ') AS g FROM "
            f"(SELECT doc_id, words, unnest(range(1, greatest(n_words - {n - 2}, 1))) AS i FROM docs) s)"
        )
        ctes.append(f"c{n} AS (SELECT doc_id, g, count(*) AS c FROM g{n} GROUP BY doc_id, g HAVING count(*) > 1)")
        if n in TOP_LIMITS:
            ctes.append(f"t{n} AS (SELECT doc_id, max(c * (length(g) - {n - 1})) AS chars FROM c{n} GROUP BY doc_id)")
        if n == 3 or n in REPEAT_LIMITS:
            ctes.append(
                f"r{n} AS (SELECT p.doc_id, count(*) AS places, sum(length(d.words[p.at])) AS chars FROM "
                f"(SELECT DISTINCT doc_id, i + k AS at FROM g{n} JOIN c{n} USING (doc_id, g), range({n}) x(k)) p "
                f"JOIN docs d USING (doc_id) GROUP BY p.doc_id)"
            )
    for n in TOP_LIMITS:
        columns.append((f"top_{n}_chars", f"coalesce((SELECT chars FROM t{n} WHERE t{n}.doc_id = d.doc_id), 0)", TOP_LIMITS[n]))
    for n in REPEAT_LIMITS:
        columns.append((f"repeat_{n}_chars", f"coalesce((SELECT chars FROM r{n} WHERE r{n}.doc_id = d.doc_id), 0)", REPEAT_LIMITS[n]))
    more = ",\n  ".join(f"CAST({value} AS BIGINT) AS {name}" for name, value, _ in columns)
    bad = " OR ".join([f"dup_line_chars > {_real(LINE_LIMIT)} * word_chars"] + [f"{name} > {_real(limit)} * word_chars" for name, _, limit in columns])
    base = f"n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words"
    return f"""WITH {', '.join(ctes)}, m AS (SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce((SELECT places FROM r3 WHERE r3.doc_id = d.doc_id), 0) AS BIGINT) AS n_repeat_words,
  CAST(coalesce(list_sum(list_transform(lines, lambda l: length(l))), 0)
       - coalesce(list_sum(list_transform(list_distinct(lines), lambda l: length(l))), 0) AS BIGINT) AS dup_line_chars,
  {more} FROM docs d)
SELECT *, ({base}) AS base_failed, NOT ({base}) AND NOT ({bad}) AS kept FROM m"""


def decontamination_sql(threshold: float = 0.8) -> str:
    """All item-sized windows that begin at a shingle of the item, by weighted Jaccard similarity."""
    split = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{M}\p{N}]+'), lambda w: w <> '')"
    cut = (
        "SELECT id, i, array_to_string(words[i:i + 4], ' ') AS g FROM "
        "(SELECT id, words, unnest(range(1, greatest(len(words) - 3, 1))) AS i FROM {0}) s"
    )
    return f"""WITH d AS (SELECT doc_id AS id, {split} AS words FROM documents), b AS (SELECT item_id AS id, {split} AS words FROM benchmark),
ds AS MATERIALIZED ({cut.format('d')}), bs AS MATERIALIZED ({cut.format('b')}),
sizes AS (SELECT id, count(*) AS m FROM bs GROUP BY id), items AS (SELECT id, g, count(*) AS c FROM bs GROUP BY id, g),
starts AS (SELECT DISTINCT ds.id AS doc_id, ds.i, items.id AS item_id FROM ds JOIN items USING (g)),
windows AS (SELECT s.doc_id, s.i, s.item_id, z.m, w.g, count(*) AS c FROM starts s JOIN sizes z ON z.id = s.item_id
            JOIN ds w ON w.id = s.doc_id AND w.i >= s.i AND w.i < s.i + z.m GROUP BY ALL),
met AS (SELECT w.doc_id, w.i, w.item_id, w.m, sum(w.c) AS size, sum(least(w.c, coalesce(t.c, 0))) AS shared
        FROM windows w LEFT JOIN items t ON t.id = w.item_id AND t.g = w.g GROUP BY ALL)
SELECT doc_id, item_id, round(max(CAST(shared AS DOUBLE) / (size + m - shared)), 6) AS similarity FROM met
WHERE CAST(shared AS DOUBLE) / (size + m - shared) >= {_real(threshold)} GROUP BY doc_id, item_id"""


def secrets_sql() -> str:
    """Spans from the lengths of what lies before each match."""
    parts = []
    for rank, (kind, (pattern, group, least)) in enumerate(RULES.items()):
        if kind == "hex":
            pattern = pattern[:-1] + f"{{{least},}}"
        quoted = ("(?s)(.*?)(" + pattern + ")").replace("'", "''")
        parts.append(f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind,
  list_sum(list_transform(before[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS first,
  length(found[k]) AS size, length(value[k]) AS measured
FROM (SELECT *, unnest(range(1, len(found) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all(text, '{quoted}', 1) AS before,
      regexp_extract_all(text, '{quoted}', 2) AS found, regexp_extract_all(text, '{quoted}', {2 + group}) AS value FROM t) m) s
WHERE length(value[k]) >= {least}""")
    span = "kind || ':' || CAST(first AS BIGINT) || ':' || CAST(first + size AS BIGINT)"
    base = ", ".join(f"'{k}'" for k in BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in BASE)
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)}),
a AS (SELECT doc_id, {counts}, string_agg({span}, ',' ORDER BY first, rank) AS spans,
             string_agg({span}, ',' ORDER BY first, rank) FILTER (WHERE kind IN ({base})) AS base FROM s GROUP BY doc_id)
SELECT t.doc_id, {', '.join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (doc_id)"""


def jaccard_sql(threshold: float = 0.8) -> str:
    """All pairs that share a shingle, and groups by recursion."""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words FROM documents),
sh AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(words[i:i + 4], ' ') AS g FROM
  (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, CASE WHEN len(words) > 0 THEN 2 ELSE 1 END))) AS i FROM d) s),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(1) ORDER BY g)) AS key FROM sh GROUP BY doc_id),
links AS MATERIALIZED (SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM sh x JOIN sh y USING (g)
  WHERE x.doc_id <> y.doc_id GROUP BY ALL) p JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b
  WHERE p.c >= {_real(threshold)} * (na.n + nb.n - p.c) - {_real(1e-9)}),
reach(a, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.r = links.a),
groups AS (SELECT a, min(r) AS class_id FROM reach GROUP BY a),
copies AS (SELECT key, count(*) AS n_copies FROM n GROUP BY key)
SELECT d.doc_id, g.class_id, coalesce((SELECT count(*) FROM links WHERE links.a = d.doc_id), 0) AS n_links, coalesce(c.n_copies, 1) AS n_copies
FROM d JOIN groups g ON g.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN copies c ON c.key = n.key"""


def negatives_sql() -> str:
    """Every row scored for every anchor; lists of doubles hold the whole numbers exactly."""
    return """WITH r AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
    CAST(list_dot_product(a.q, r.q) AS BIGINT) AS score
  FROM r a JOIN r ON a.vec_id <> r.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id,
  CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same
  AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10"""


def chat_sql() -> str:
    """A turn adds the 20 characters of its control strings, and one for every control string inside role or text."""
    inside = r"(<\\*/?s>|\[\\*/?INST\])"
    probe = "</s>[INST] ok [/INST]"
    written = lambda c: f"length({c}) + len(regexp_extract_all({c}, '{inside}'))"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, md5(text))) AS loss_sha256,
  CAST(sum(20 + {written('role')} + {written('text')}) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""
