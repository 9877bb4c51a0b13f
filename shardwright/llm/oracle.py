"""DuckDB SQL of the dealt operators' queries, where SQL can express them on whole tables.

The others (drawn mix, library tokenizers, fitted models) are held against brute-force
versions in the tests.
"""

from __future__ import annotations

from shardwright.llm.common import LOWER, UPPER
from shardwright.llm.license_scan import BASE, EVIDENCE, NOTICES, mandatory_words, parts_of
from shardwright.llm.url_reputation import RULES, SUFFIXES, Bound

WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
LOWERED = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')"

OP1 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(ws) AS word, unnest(range(len(ws))) AS i FROM (SELECT r, {WORDS} AS ws FROM d)),
n AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars,
    count(*) FILTER (WHERE regexp_full_match(word, '[\\x21-\\x40]+')) AS bare FROM w GROUP BY r),
top AS (SELECT r, max(c) AS top FROM (SELECT r, word, count(*) AS c FROM w GROUP BY r, word) GROUP BY r),
g AS (SELECT r, i, [word, lead(word, 1) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o] AS gram,
    lead(word, 4) OVER o AS last FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g WHERE last IS NOT NULL),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM (SELECT r, i, unnest(range(5)) AS k FROM twice WHERE c > 1) GROUP BY r),
l AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d)
    WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
f AS (SELECT doc_id, t, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(bare, 0) AS bare, coalesce(top, 0) AS top,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS letters,
    length(regexp_replace(t, '[^A-Z]', '', 'g')) AS upper_letters, (length(t) - length(replace(t, '!!', ''))) // 2 AS marks,
    length(t) - length(replace(t, chr(10), '')) + 1 AS n_lines
    FROM d LEFT JOIN n USING (r) LEFT JOIN top USING (r) LEFT JOIN rep USING (r) LEFT JOIN l USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM f)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
    NOT base_failed AND NOT (100 * n_symbols > 10 * n_words) AND NOT (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)
    AND 2 * n_words <= word_chars AND word_chars <= 15 * n_words AND NOT (letters >= 20 AND 10 * upper_letters > 7 * letters)
    AND NOT (10 * marks > 3 * n_words) AND NOT (n_words >= 10 AND 10 * top > 4 * n_words) AND NOT (2 * bare > n_words) AS kept
FROM b
"""

OP2 = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
ok AS (SELECT * FROM e WHERE len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
    AND len(list_filter(x, lambda v: v <> 0)) > 0),
p AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id < b.vec_id AND len(a.x) = len(b.x)
    WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
k AS MATERIALIZED (SELECT u, v FROM p UNION ALL SELECT v, u FROM p),
r AS (SELECT vec_id, vec_id AS root FROM embeddings UNION SELECT k.v, r.root FROM r JOIN k ON k.u = r.vec_id),
c AS (SELECT vec_id, min(root) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM k GROUP BY u)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""


def _op5() -> str:
    b = Bound()
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for _, h, p in RULES]
    order = sorted(range(len(RULES)), key=lambda i: -len(RULES[i][1] + RULES[i][2]))
    rule = " ".join(f"{fits[i]} THEN '{RULES[i][1]}{RULES[i][2]}'" for i in order)
    verdict = " ".join(f"{fits[i]} THEN '{RULES[i][0]}'" for i in order)
    two_part = ", ".join(f"'{s}'" for s in SUFFIXES)

    def level(name: str, rows: str, parents: str, keys: str) -> str:
        noise = "p * (1 - p)"
        rho = f"(sum((bad - n * p) * (bad - n * p) - n * {noise}) / nullif(sum(n * (n - 1) * {noise}), 0))"
        return f"""
{name}0 AS (SELECT x.*, p FROM {rows} x {parents}),
{name}m AS (SELECT greatest({b.least}, least({b.most}, coalesce(CASE WHEN {rho} > 0 THEN 1 / {rho} - 1 ELSE {b.most} END, {b.most}))) AS m FROM {name}0),
{name} AS (SELECT {keys}, n + m AS w, (bad + m * p) / (n + m) AS q FROM {name}0, {name}m)"""

    return f"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    TRY_CAST(regexp_extract(url, '/(\\d{{1,18}})(?:\\.html|/)?(?:[?#].*)?$', 1) AS BIGINT) AS doc_id FROM pages),
o AS (SELECT page_id, max(bad) AS bad FROM (SELECT page_id, CASE WHEN quality = 0 OR toxic = 1 THEN 1
    WHEN quality IS NOT NULL AND toxic IS NOT NULL THEN 0 END AS bad FROM u JOIN labels USING (doc_id)) WHERE bad IS NOT NULL GROUP BY page_id),
hc AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad, regexp_extract(host, '(?:[^.]*\\.)?[^.]*$') AS two, regexp_extract(host, '(?:[^.]*\\.){{0,2}}[^.]*$') AS three
    FROM u LEFT JOIN o USING (page_id) GROUP BY host),
hd AS (SELECT host, n, bad, CASE WHEN two IN ({two_part}) THEN three ELSE two END AS domain FROM hc),
dc AS (SELECT domain, sum(n) AS n, sum(bad) AS bad, CASE WHEN contains(domain, '.') THEN regexp_replace(domain, '^[^.]*\\.', '') ELSE '' END AS suffix
    FROM hd GROUP BY domain),
sc AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dc GROUP BY suffix),
tot AS (SELECT coalesce(sum(bad) / nullif(sum(n), 0), 0) AS p FROM sc),{level("s", "sc", ", tot", "suffix")},{level("d", "dc", "JOIN (SELECT suffix, q AS p FROM s) USING (suffix)", "domain")},
{level("h", "hd", "JOIN (SELECT domain, q AS p FROM d) USING (domain)", "host")},
low AS (SELECT host, q - {b.z} * sqrt(q * (1 - q) / (w + 1)) AS low FROM h)
SELECT page_id, host, path, CASE {rule} END AS rule,
    CASE {verdict} ELSE CASE WHEN low > {b.max_bad} THEN 'block' ELSE 'allow' END END AS verdict
FROM u LEFT JOIN low USING (host)
"""


OP9 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {LOWERED} AS t FROM documents),
w AS (SELECT doc_id, {WORDS} AS ws FROM d),
s AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS MATERIALIZED (SELECT u, v FROM (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL)
    JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT p.v, r.root FROM r JOIN p ON p.u = r.doc_id),
c AS (SELECT doc_id, min(root) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM documents JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP11 = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({LOWERED}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
g AS MATERIALIZED (SELECT lang, m, g, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: array_to_string(ws[i:i + m - 1], ' '))) AS g
    FROM w, (VALUES (1), (2), (3), (4)) v(m) WHERE len(ws) >= m) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, g, f AS a, k, array_to_string(ws[1:k], ' ') AS lp, array_to_string(ws[k + 1:m], ' ') AS rp
    FROM (SELECT lang, m, g, f, string_split(g, ' ') AS ws, unnest(range(1, m)) AS k FROM g WHERE m > 1)),
s AS (SELECT c.lang, c.g, a, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * a) // (x.f::HUGEINT + y.f) AS BIGINT) AS score, k
    FROM c JOIN g x ON x.lang = c.lang AND x.g = lp JOIN g y ON y.lang = c.lang AND y.g = rp),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, g ORDER BY score, k) AS o FROM s) WHERE o = 1),
h AS (SELECT lang, sub, max(f) AS longer FROM (SELECT lang, f, unnest(CASE m WHEN 3 THEN [ws[1:2], ws[2:3]] ELSE [ws[1:2], ws[2:3], ws[3:4], ws[1:3], ws[2:4]] END) AS part,
    array_to_string(part, ' ') AS sub FROM (SELECT lang, m, f, string_split(g, ' ') AS ws FROM g WHERE m > 2)) GROUP BY lang, sub),
z AS (SELECT b.lang, b.g AS phrase, a, l, r, score FROM b LEFT JOIN h ON h.lang = b.lang AND h.sub = b.g WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z) JOIN t USING (lang) WHERE rank <= 2000
"""

OP12 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS u, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS x, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS y,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
    WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, array_to_string(u[1:x], '') AS p, array_to_string(u[x + 1:y], '') AS m, array_to_string(u[y + 1:n], '') AS s FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
    CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
    sha256(t) AS restored_sha256 FROM p
"""


def template_regex(markup: str) -> str:
    """A template as a regular expression over words that each follow a space."""
    out = ""
    for kind, value in parts_of(markup):
        if kind == "words":
            out += "".join(" " + w.decode() for w in value)
        elif kind == "any":
            out += f"( [^ ]+){{{value[0]},{value[1]}}}"
        elif kind == "match":
            out += "(" + "|".join("".join(" " + x.decode() for x in w) for w in value) + ")"
        else:
            out += "(" if kind == "begin" else ")?"
    return out


def _op13() -> str:
    found = [f"regexp_matches(s, '{template_regex(t.markup)} ')" for t in BASE + NOTICES]
    weight = [mandatory_words(t.markup) for t in BASE + NOTICES]
    places = []
    for t in BASE:
        words = t.markup.split()
        same = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(words))
        places.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {same}), lambda i: [i - 1, {BASE.index(t)}])")
    name = lambda rows: ", ".join(f"CASE WHEN {f} THEN '{t.label}' END" for f, t in rows)
    label = lambda rows: f"array_to_string(list_sort(list_distinct([{name(rows)}])), ',')"
    both = list(zip(found, BASE + NOTICES))
    scores = ", ".join(f"CASE WHEN {f} THEN {m} / ({m} + {EVIDENCE}.0)::DOUBLE ELSE 0 END" for f, m in zip(found, weight))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS s, {" || ".join(places)} AS hit FROM w)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(hit) AS BIGINT) AS n_base, CAST(list_min(list_transform(hit, lambda x: x[1])) AS BIGINT) AS first_word,
    CAST(list_max(list_transform(hit, lambda x: x[1])) AS BIGINT) AS last_word, {label(both[: len(BASE)])} AS base_labels, {label(both)} AS labels,
    CAST(greatest({scores}) AS DOUBLE) AS score FROM p
"""


SQL: dict[str, str] = {"op1_quality": OP1, "op2_embed_dedup": OP2, "op5_url_reputation": _op5(), "op9_parity_join": OP9, "op11_phrases": OP11, "op12_fill_middle": OP12, "op13_license_scan": _op13()}
