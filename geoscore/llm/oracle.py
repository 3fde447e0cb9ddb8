"""DuckDB SQL for the operators' queries that SQL can express, each by its plainest path."""

from __future__ import annotations

from geoscore.llm import chat, decontaminate, neardup, secrets

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x20\x09-\x0D]+')"
)


def near_duplicates(shingle: int) -> str:
    """All pairs that share a shingle, compared; components by the smallest id reached."""
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {shingle} THEN [list_aggregate(w, 'string_agg', ' ')]
  ELSE list_transform(range(1, len(w) - {shingle} + 2), lambda i: list_aggregate(w[i:i + {shingle - 1}], 'string_agg', ' ')) END) AS grams FROM w),
n AS (SELECT doc_id, len(grams) AS n FROM s),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
overlap AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM overlap JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {neardup.PERCENT} * (x.n + y.n - k)),
reach(doc_id, r) AS (SELECT doc_id, doc_id FROM n UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON reach.r = links.a)
SELECT doc_id, CAST(any_value(n.n) AS BIGINT) AS n_shingles, min(r) AS component_id, min(r) = doc_id AS kept
FROM reach JOIN n USING (doc_id) GROUP BY doc_id"""


def _spans(rule: secrets.Rule) -> str:
    """A rule's spans: each match taken with the text before it, so lengths add up to places."""
    regex = rule.regex.replace("'", "''")
    whole = f"(?s)(.*?)({regex})"
    parts = [f"regexp_extract_all(t, '{whole}', {g})" for g in (1, 2, 2 + rule.group)]
    return f"""
SELECT doc_id, '{rule.kind}' AS kind, gap + hit - length(h) AS s, gap + hit AS e FROM (
  SELECT doc_id, hits[i] AS h, kept[i] AS k,
    coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) AS gap,
    list_sum(list_transform(hits[1:i], lambda x: length(x))) AS hit
  FROM (SELECT doc_id, {parts[0]} AS gaps, {parts[1]} AS hits, {parts[2]} AS kept FROM d), range(1, 100000) r(i) WHERE i <= len(hits))
WHERE length(k) >= {rule.least}"""


def secret_scan() -> str:
    kinds = [r.kind for r in secrets.RULES]
    listed = ", ".join(f"'{k}'" for k in kinds)
    base = ", ".join(f"'{k}'" for k in secrets.BASE)
    written = "string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, list_position(["
    counts = ", ".join(
        f"CAST(count(*) FILTER (kind = '{k}') AS BIGINT) AS n_{k}" for k in secrets.BASE
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_spans(r) for r in secrets.RULES)})
SELECT d.doc_id, {counts},
  sha256(coalesce({written}{listed}], kind)) FILTER (kind IN ({base})), '')) AS base_sha256,
  coalesce({written}{listed}], kind)), '') AS spans
FROM d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id"""


def chat_formatting(control: str) -> str:
    def escaped(text: str) -> str:
        return f"replace(replace(replace({text}, '\\', '\\\\'), '[', '\\['), '<', '\\<')"

    empty = {kind: len(chat.brackets([(kind, "")])) - len(chat.START) for kind in ("user", "assistant", "")}
    return f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{control}'), (-7, 1, 'assistant', '{control}'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST({len(chat.START)} + sum(length({escaped('text')}) + CASE role WHEN 'user' THEN {empty['user']}
    WHEN 'assistant' THEN {empty['assistant']} ELSE {empty['']} + length({escaped('role')}) END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id"""


def leaks() -> str:
    """Windows of an item's length wherever enough of its shingles lie in line, all compared."""
    k = decontaminate.SHINGLE
    tokens = r"list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '')"

    def grams(w: str) -> str:
        return (
            f"CASE WHEN len({w}) = 0 THEN [] WHEN len({w}) < {k} THEN [list_aggregate({w}, 'string_agg', ' ')] "
            f"ELSE list_transform(range(1, len({w}) - {k} + 2), lambda i: list_aggregate({w}[i:i + {k - 1}], 'string_agg', ' ')) END"
        )

    return f"""
WITH i AS (SELECT item_id, w, {grams('w')} AS g FROM (SELECT DISTINCT item_id, {tokens} AS w FROM benchmark) WHERE len(w) > 0),
d AS (SELECT doc_id, w, {grams('w')} AS g FROM (SELECT DISTINCT doc_id, {tokens} AS w FROM documents) WHERE len(w) > 0),
ig AS (SELECT item_id, unnest(g) AS gram, generate_subscripts(g, 1) AS j FROM i),
dg AS (SELECT doc_id, unnest(g) AS gram, generate_subscripts(g, 1) AS p FROM d),
placed AS (SELECT doc_id, item_id, greatest(least(p - j, len(d.w) - len(i.w)), 0) AS start, count(*) AS hits
  FROM dg JOIN ig USING (gram) JOIN d USING (doc_id) JOIN i USING (item_id) GROUP BY 1, 2, 3
  HAVING count(*) >= any_value(len(i.g)) * {decontaminate.IN_LINE}),
win AS (SELECT doc_id, item_id, start, i.g AS g, d.w[start + 1:start + len(i.w)] AS v FROM placed JOIN d USING (doc_id) JOIN i USING (item_id)),
seen AS (SELECT doc_id, item_id, start, g, {grams('v')} AS s FROM win),
overlap AS (SELECT *, list_sum(list_transform(list_distinct(s), lambda x: least(len(list_filter(s, lambda y: y = x)), len(list_filter(g, lambda y: y = x))))) AS k FROM seen),
sim AS (SELECT doc_id, item_id, start, k / CAST(len(s) + len(g) - k AS DOUBLE) AS similarity FROM overlap)
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start FROM sim WHERE similarity >= {decontaminate.SIMILAR}
QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1"""


NEIGHBOURS = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0)
SELECT q.vec_id AS query_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.e, c.e) DESC, c.vec_id) AS INTEGER) AS rank,
  c.vec_id AS vec_id, list_inner_product(q.e, c.e) AS score
FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id QUALIFY rank <= 20"""
