"""SQL, as DuckDB reads it, of the training-data queries that SQL can express."""

from __future__ import annotations

from calibra.llm.secrets import PRIVATE_KEY

# The added kinds of op10, as plain patterns. The first group of web_token is the
# character before the token, which isn't part of it.
_SECRETS = (
    ("private_key", PRIVATE_KEY),
    ("web_token", r"(^|[^A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("repo_token", r"(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{36,}"),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    ("bearer", r"[Bb]earer\x20+[A-Za-z0-9._~+/-]{20,}=*"),
    ("url_login", r"[a-z][a-z0-9+.-]{0,30}://[^\s:/@]+:[^\s:/@]+@[A-Za-z0-9.-]+"),
)
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(0, length({_DIGITS})), lambda i: CASE WHEN i % 2 = 0 THEN CAST(reverse({_DIGITS})[i + 1] AS INT) ELSE (2 * CAST(reverse({_DIGITS})[i + 1] AS INT)) % 10 + (2 * CAST(reverse({_DIGITS})[i + 1] AS INT)) // 10 END)) % 10 = 0"
#: Kind, pattern, group that a condition sees as g, condition on the match v, skipped group.
_PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0, "true", None),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0, "list_bool_and(list_transform(string_split(v, '.'), lambda x: length(ltrim(x, '0')) <= 3 AND CAST('0' || right(ltrim(x, '0'), 3) AS INT) <= 255))", None),
    ("card", r"[0-9]([\x20-]?[0-9])+", 0, f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_LUHN}", None),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", 0, f"length({_DIGITS}) BETWEEN 10 AND 15", None),
)
_SECRET_KINDS = (
    ("assign", r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, "length(g) >= 6", None),
    ("access", r"AKIA[A-Z0-9]+", 0, "length(v) >= 20", None),
    ("hex", r"[0-9a-f]+", 0, "length(v) >= 24", None),
    *((k, p, 0, "true", 1 if k == "web_token" else None) for k, p in _SECRETS),
)


def _digest(kinds: tuple, base: int) -> str:
    """Counts of the first kinds, the digest of their spans, all spans, and their number."""
    parts = []
    for order, (kind, pattern, group, condition, skipped) in enumerate(kinds):
        p = pattern.replace("'", "''")
        skip = f"length(regexp_extract(v, '{p}', {skipped}))" if skipped else "0"
        parts.append(f"""SELECT n, {order} AS o, '{kind}' AS kind, pos + {skip} AS s, pos + length(v) AS e FROM (
            SELECT n, ms[i] AS v, gs[i] AS g, list_sum(list_transform(ps[1:i], lambda z: length(z))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda z: length(z))), 0) AS pos
            FROM (SELECT n, regexp_extract_all(t, '{p}', 0) AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, string_split_regex(t, '{p}') AS ps FROM d WHERE regexp_matches(t, '{p}')), unnest(range(1, len(ms) + 1)) AS u(i)
        ) WHERE {condition}""")
    line = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, o)"
    counts = ", ".join(f"count(*) FILTER (o = {i}) AS n_{k[0]}" for i, k in enumerate(kinds[:base]))
    return f"""WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
        found AS (SELECT DISTINCT * FROM ({" UNION ALL ".join(parts)}))
        SELECT any_value(doc_id) AS doc_id, {counts}, sha256(coalesce({line[:-1]}) FILTER (o < {base}), '')) AS base_sha256, coalesce({line}, '') AS spans, count(o) AS n_spans
        FROM d LEFT JOIN found USING (n) GROUP BY n"""


PII = _digest(_PII, 4)
SECRETS = _digest(_SECRET_KINDS, 3)

NGRAM_JOIN = r"""
    WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    sets AS MATERIALIZED (SELECT n, doc_id, CASE WHEN len(w) >= 4 THEN list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
    sh AS MATERIALIZED (SELECT n, len(g) AS size, unnest(g) AS s FROM sets),
    links AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM sh a JOIN sh b ON a.s = b.s AND a.n <> b.n GROUP BY a.n, b.n, a.size, b.size HAVING 100 * count(*) >= 85 * (a.size + b.size - count(*))),
    reach AS (SELECT n, n AS m FROM sets UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a)
    SELECT s.doc_id, len(s.g) AS n_shingles, min(o.doc_id) AS component_id FROM sets s JOIN reach r ON s.n = r.n JOIN sets o ON o.n = r.m GROUP BY s.n, s.doc_id, len(s.g)"""

_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))"

NEAR_VECTORS = f"""
    WITH RECURSIVE v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, CASE WHEN {_USABLE} AND list_bool_or(list_transform(embedding, lambda x: x <> 0)) THEN embedding::DOUBLE[] END AS x FROM embeddings),
    links AS MATERIALIZED (SELECT a.n AS a, b.n AS b FROM v a JOIN v b ON a.n <> b.n AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
    reach AS (SELECT n, n AS m FROM v UNION SELECT r.n, l.b FROM reach r JOIN links l ON r.m = l.a),
    roots AS (SELECT r.n, min(o.vec_id) AS component_id FROM reach r JOIN v o ON o.n = r.m GROUP BY r.n),
    counts AS (SELECT a AS n, count(*) AS c FROM links GROUP BY a)
    SELECT vec_id, coalesce(c, 0) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN roots USING (n) LEFT JOIN counts USING (n)"""

TOP_K = f"""
    WITH v AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings WHERE {_USABLE}),
    s AS (SELECT a.n, a.vec_id AS query_id, b.n AS m, b.vec_id, CAST(list_sum(list_transform(range(1, least(len(a.q), len(b.q)) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score FROM v a JOIN v b ON a.n <> b.n WHERE a.vec_id % 100 = 0)
    SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id NULLS LAST, m) AS r FROM s) WHERE r <= 10"""

#: Default weights are the square roots of the sources' sizes, exact as doubles; their multiples by 2^52 are whole.
MIX = """
    WITH RECURSIVE k AS (SELECT s, n, (n + 15) // 16 AS b, CAST(sqrt(n) * 4503599627370496 AS HUGEINT) AS w FROM (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1)),
    all_ AS MATERIALIZED (SELECT CAST(sum(w) AS HUGEINT) AS total, list(b ORDER BY s) AS bs, list(w ORDER BY s) AS ws, list(s ORDER BY s) AS ss FROM k),
    step(t, c, pick, j) AS (
        SELECT CAST(0 AS HUGEINT), list_transform(bs, lambda x: CAST(0 AS HUGEINT)), CAST(NULL AS BIGINT), CAST(NULL AS HUGEINT) FROM all_
        UNION ALL
        SELECT now + 1, list_transform(range(1, len(c) + 1), lambda i: c[i] + CASE WHEN i = p THEN 1 ELSE 0 END), p, c[p] FROM (
            SELECT *, CAST(list_sort(list_transform(list_filter(open_, lambda i: c[i] * total // ws[i] <= now), lambda i: [(c[i] + 1) * total // ws[i] + CASE WHEN ((c[i] + 1) * total) % ws[i] = 0 THEN 0 ELSE 1 END, CAST(i AS HUGEINT)]))[1][2] AS BIGINT) AS p FROM (
                SELECT *, greatest(t, list_min(list_transform(open_, lambda i: c[i] * total // ws[i]))) AS now FROM (
                    SELECT *, list_filter(range(1, len(c) + 1), lambda i: c[i] < bs[i]) AS open_ FROM step, all_) WHERE len(open_) > 0))),
    slots AS (SELECT ss[pick] AS source, j AS block, t - 1 AS slot FROM step, all_ WHERE pick IS NOT NULL),
    docs AS (SELECT doc_id, coalesce(source, '') AS source, row_number() OVER (PARTITION BY coalesce(source, '') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS number FROM documents)
    SELECT doc_id, source, number AS source_number, number // 16 AS block, CAST(slot AS BIGINT) AS slot, CAST(slot * 16 + number % 16 AS BIGINT) AS mix_position FROM docs JOIN slots USING (source) WHERE slots.block = number // 16"""

FILTER_AUDIT = r"""
    WITH RECURSIVE ordered AS (SELECT '' AS o UNION ALL SELECT o || c FROM ordered, (SELECT unnest(['A','B','C','D','E']) AS c) WHERE length(o) < 5 AND position(c IN o) = 0),
    orders AS (SELECT o FROM ordered WHERE length(o) = 5),
    least AS (SELECT coalesce(text, '') AS t, min(doc_id) AS least FROM documents GROUP BY 1),
    marks AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
    d AS MATERIALIZED (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    f AS MATERIALIZED (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
        || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 5 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
        || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
        FROM d JOIN least USING (t) LEFT JOIN marks USING (doc_id)),
    r AS (SELECT part, o, good, toxic, fails, coalesce(list_min(list_transform(list_filter(string_split(fails, ''), lambda x: x <> ''), lambda x: position(x IN o))), 6) AS first_ FROM f, orders),
    s AS (SELECT part, o, i AS step, o[i] AS letter, count(*) FILTER (first_ > i) AS kept, count(*) FILTER (first_ = i) AS removed, count(*) FILTER (first_ < i AND position(o[i] IN fails) > 0) AS redundant,
        count(*) FILTER (fails = o[i]) AS unique_fails, count(*) FILTER (first_ = i AND good = 1) AS good_lost, count(*) FILTER (first_ = i AND toxic = 1) AS toxic_lost
        FROM r, unnest(range(1, 6)) AS u(i) GROUP BY ALL)
    SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM s"""

COLLOCATIONS = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
    w AS MATERIALIZED (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
    f AS MATERIALIZED (SELECT lang, m, array_to_string(w[i:i + m - 1], ' ') AS phrase, count(*) AS f FROM w, unnest(range(1, len(w) + 1)) AS u(i), unnest(range(1, 5)) AS v(m) WHERE i + m - 1 <= len(w) GROUP BY ALL),
    totals AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
    c AS MATERIALIZED (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM f WHERE m >= 2 AND f >= 30),
    cuts AS (SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM c, unnest(range(1, 4)) AS u(k) WHERE k < m),
    scored AS (SELECT cuts.lang, cuts.phrase, a, k, l.f AS l, r.f AS r, CAST(CAST(a AS HUGEINT) * 2000000 // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
        FROM cuts JOIN f l ON l.lang = cuts.lang AND l.phrase = x JOIN f r ON r.lang = cuts.lang AND r.phrase = y),
    weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    covered AS (SELECT lang, array_to_string(w[i:i + n - 1], ' ') AS phrase, max(a) AS most FROM c, unnest(range(1, 4)) AS u(i), unnest(range(2, 4)) AS v(n) WHERE n < m AND i + n - 1 <= m GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
    FROM weakest LEFT JOIN covered USING (lang, phrase) JOIN totals USING (lang) WHERE most IS NULL OR 100 * most < 80 * a QUALIFY rank <= 2000"""

ORACLES = {
    "op1_embedding_near_dedup": NEAR_VECTORS,
    "op2_pii": PII,
    "op4_ngram_jaccard_join": NGRAM_JOIN,
    "op7_mix_sources": MIX,
    "op9_exact_top_k": TOP_K,
    "op10_secret_scan": SECRETS,
    "op11_filter_interaction_audit": FILTER_AUDIT,
    "op12_phrase_collocations": COLLOCATIONS,
}
