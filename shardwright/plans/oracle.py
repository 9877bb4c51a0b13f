"""DuckDB restatements of the registered queries (the correctness oracle).

Written independently of the Spark code paths: BPE training is an unrolled chain of
full recounts (one materialised CTE per merge), encoding a ``replace`` fold, packing
an unnest with global positions.  Token strings use the same one-code-point-per-
token convention (ids < 0xD800 here, so code point = id).
"""

from __future__ import annotations

from shardwright.plans.queries import (
    ALPHA,
    AUDIT_CONTEXT,
    AUDIT_VOCAB,
    BATCH,
    BYTE_VOCAB,
    CONTEXT,
    EOS_ID,
    LONG_MERGES,
    SEED,
    SHARD_SIZE,
    SPACE_ID,
    SPECIALS,
    TEXT_LANG,
    TRAIN_MERGES,
    VAL_FRACTION,
)

FIRST_MERGE = 256 + len(SPECIALS)


def byte_str(t: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all(hex(encode({t})), '..'), "
        f"lambda h: chr(('0x' || h)::INTEGER)), '')"
    )


def byte_ids(t: str) -> str:
    return f"list_transform(regexp_extract_all(hex(encode({t})), '..'), lambda h: ('0x' || h)::INTEGER)"


def chars(s: str) -> str:
    return f"regexp_extract_all({s}, '(?s).')"


def ids_digest(lst: str) -> str:
    return f"md5(array_to_string({lst}, ','))"


SPLIT_EXPR = (
    f"CASE WHEN ('0x' || substr(md5('{SEED}:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT / 4294967296.0 "
    f"< {VAL_FRACTION} THEN 'val' ELSE 'train' END"
)


def merge_chain(n: int = TRAIN_MERGES) -> str:
    """CTEs c0..cn (chunk states) and p1..pn (best pair of each round, with its count)."""
    ctes = [f"c0 AS MATERIALIZED (SELECT {byte_str('text')} AS s, count(*) AS w FROM documents WHERE text <> '' GROUP BY text)"]
    for i in range(1, n + 1):
        ctes.append(
            f"p{i} AS MATERIALIZED (SELECT k, sum(w) AS n FROM (SELECT w, unnest(list_transform(range(1, len(ch)), "
            f"lambda j: ch[j] || ch[j + 1])) AS k FROM (SELECT w, {chars('s')} AS ch FROM c{i - 1})) "
            f"GROUP BY k ORDER BY n DESC, k LIMIT 1)"
        )
        ctes.append(
            f"c{i} AS MATERIALIZED (SELECT replace(s, (SELECT k FROM p{i}), chr({FIRST_MERGE + i - 1})) AS s, w FROM c{i - 1})"
        )
    return ",\n".join(ctes)


def merges_union(n: int = TRAIN_MERGES) -> str:
    return " UNION ALL ".join(
        f"SELECT {i - 1} AS rank, unicode(substring(k, 1, 1)) AS left_id, unicode(substring(k, 2, 1)) AS right_id, "
        f"{FIRST_MERGE + i - 1} AS new_id, n FROM p{i}"
        for i in range(1, n + 1)
    )


def encode_fold(expr: str, n: int = TRAIN_MERGES) -> str:
    for i in range(1, n + 1):
        expr = f"replace({expr}, (SELECT k FROM p{i}), chr({FIRST_MERGE + i - 1}))"
    return expr


def q_bpe_train() -> str:
    return (
        f"WITH {merge_chain()}\n"
        f"SELECT CAST(rank AS INTEGER) AS rank, CAST(left_id AS INTEGER) AS left_id, CAST(right_id AS INTEGER) AS right_id, "
        f"CAST(new_id AS INTEGER) AS new_id, CAST(n AS BIGINT) AS n FROM ({merges_union()})"
    )


def q_bpe_vocab() -> str:
    def hexof(idcol: str, upto: int) -> str:
        whens = [f"WHEN {idcol} < 256 THEN printf('%02X', {idcol})"]
        for j, sp in enumerate(SPECIALS):
            whens.append(f"WHEN {idcol} = {256 + j} THEN hex(encode('{sp}'))")
        for j in range(1, upto):
            whens.append(f"WHEN {idcol} = {FIRST_MERGE + j - 1} THEN (SELECT hx FROM v{j})")
        return "CASE " + " ".join(whens) + " END"

    vs = []
    for i in range(1, TRAIN_MERGES + 1):
        vs.append(
            f"v{i} AS MATERIALIZED (SELECT {FIRST_MERGE + i - 1} AS token_id, "
            f"{hexof('l', i)} || {hexof('r', i)} AS hx FROM "
            f"(SELECT unicode(substring(k, 1, 1)) AS l, unicode(substring(k, 2, 1)) AS r FROM p{i}))"
        )
    parts = ["SELECT i AS token_id, 'byte' AS kind, printf('%02X', i) AS bytes_hex FROM range(256) t(i)"]
    for j, sp in enumerate(SPECIALS):
        parts.append(f"SELECT {256 + j}, 'special', hex(encode('{sp}'))")
    for i in range(1, TRAIN_MERGES + 1):
        parts.append(f"SELECT token_id, 'merge', hx FROM v{i}")
    return (
        f"WITH {merge_chain()},\n" + ",\n".join(vs) + "\n"
        f"SELECT CAST(token_id AS INTEGER) AS token_id, kind, bytes_hex FROM ({' UNION ALL '.join(parts)})"
    )


def q_bpe_encode() -> str:
    enc = encode_fold(byte_str("text"))
    return (
        f"WITH {merge_chain()},\n"
        f"e AS (SELECT doc_id, {enc} AS s FROM documents)\n"
        f"SELECT doc_id, CAST(length(s) AS BIGINT) AS n_tokens, "
        f"{ids_digest(f'list_transform({chars('s')}, lambda c: unicode(c))')} AS digest FROM e"
    )


def q_compression() -> str:
    enc = encode_fold(byte_str("text"))
    return (
        f"WITH {merge_chain()},\n"
        f"e AS (SELECT lang, octet_length(encode(text)) AS nb, length({enc}) AS nt FROM documents)\n"
        f"SELECT lang, CAST(sum(nb) AS BIGINT) AS n_bytes, CAST(sum(nt) AS BIGINT) AS n_tokens, "
        f"round(sum(nb) / sum(nt), 6) AS bytes_per_token FROM e GROUP BY lang"
    )


def long_chain() -> str:
    """CTE ``m(rank, k, n)``: LONG_MERGES merges of the conversations, each from a full recount."""
    chars_of = "SELECT x.w AS w, regexp_extract_all(x.s, '(?s).') AS ch FROM (SELECT unnest(state) AS x)"
    pairs = f"SELECT w, unnest(list_transform(list_zip(ch[:-2], ch[2:]), lambda z: z[1] || z[2])) AS k FROM ({chars_of})"
    best = f"SELECT {{'k': k, 'n': n}} FROM (SELECT k, CAST(sum(w) AS BIGINT) AS n FROM ({pairs}) GROUP BY k) ORDER BY n DESC, k LIMIT 1"
    return (
        f"WITH RECURSIVE c AS (SELECT {byte_str('text')} AS s, count(*) AS w FROM conversations WHERE text <> '' GROUP BY text),\n"
        "r AS (SELECT 0 AS rank, CAST(NULL AS VARCHAR) AS k, CAST(0 AS BIGINT) AS n, (SELECT list({'s': s, 'w': w}) FROM c) AS state\n"
        f"UNION ALL SELECT rank + 1, best.k, best.n, list_transform(state, lambda x: {{'s': replace(x.s, best.k, chr({FIRST_MERGE} + CAST(rank AS INTEGER))), 'w': x.w}})\n"
        f"FROM (SELECT rank, state, ({best}) AS best FROM r) WHERE rank < {LONG_MERGES} AND best.k IS NOT NULL),\n"
        "m AS MATERIALIZED (SELECT rank - 1 AS rank, k, n FROM r WHERE rank > 0)"
    )


def q_bpe_train_long() -> str:
    return (
        f"{long_chain()}\nSELECT CAST(rank AS INTEGER) AS rank, CAST(unicode(substring(k, 1, 1)) AS INTEGER) AS left_id, "
        f"CAST(unicode(substring(k, 2, 1)) AS INTEGER) AS right_id, CAST({FIRST_MERGE} + rank AS INTEGER) AS new_id, n FROM m"
    )


def q_bpe_encode_long() -> str:
    fold = f"list_reduce(ms, lambda acc, x: replace(acc, x[1:2], x[3:3]), {byte_str('text')})"
    return (
        f"{long_chain()},\nl AS (SELECT list(k || chr({FIRST_MERGE} + CAST(rank AS INTEGER)) ORDER BY rank) AS ms FROM m),\n"
        f"e AS (SELECT doc_id, {fold} AS s FROM documents, l)\n"
        f"SELECT doc_id, CAST(length(s) AS BIGINT) AS n_tokens, {ids_digest(f'list_transform({chars('s')}, lambda c: unicode(c))')} AS digest FROM e"
    )


TOKENS_CTE = (
    f"d AS (SELECT doc_id, {SPLIT_EXPR} AS split, {byte_ids('text')} || [{EOS_ID}] AS ids FROM documents),\n"
    f"o AS (SELECT split, doc_id, ids, CAST(len(ids) AS BIGINT) AS n, "
    f"CAST(coalesce(sum(len(ids)) OVER (PARTITION BY split ORDER BY doc_id "
    f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM d),\n"
    f"t AS (SELECT split, start + i AS pos, tok FROM "
    f"(SELECT split, start, unnest(ids) AS tok, unnest(range(len(ids))) AS i FROM o)),\n"
    f"sh AS (SELECT split, CAST(pos // {SHARD_SIZE} AS INTEGER) AS shard_idx, list(tok ORDER BY pos) AS tokens "
    f"FROM t GROUP BY split, pos // {SHARD_SIZE}),\n"
    f"ex AS (SELECT split, shard_idx, CAST(unnest(range((len(tokens) - 1) // {CONTEXT})) AS INTEGER) AS example_idx, "
    f"tokens FROM sh),\n"
    f"exy AS (SELECT split, shard_idx, example_idx, "
    f"tokens[example_idx * {CONTEXT} + 1 : example_idx * {CONTEXT} + {CONTEXT}] AS x, "
    f"tokens[example_idx * {CONTEXT} + 2 : example_idx * {CONTEXT} + {CONTEXT + 1}] AS y FROM ex)"
)

def q_file_job() -> str:
    ids = f"list_transform({chars('s')}, lambda c: unicode(c)) || [{EOS_ID}]"
    return (
        f"WITH {merge_chain()},\n"
        f"e AS (SELECT doc_id, lang, {encode_fold(byte_str('text'))} AS s FROM documents WHERE text IS NOT NULL),\n"
        f"d AS (SELECT doc_id, lang, {ids} AS ids FROM e),\n"
        "o AS (SELECT ids, coalesce(sum(len(ids)) OVER (ORDER BY lang, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),\n"
        "t AS (SELECT start + i AS pos, tok FROM (SELECT start, unnest(ids) AS tok, unnest(range(len(ids))) AS i FROM o)),\n"
        f"sh AS (SELECT CAST(pos // {SHARD_SIZE} AS INTEGER) AS shard_idx, list(tok ORDER BY pos) AS tokens FROM t GROUP BY pos // {SHARD_SIZE})\n"
        "SELECT 'train' AS split, shard_idx, printf('train_%05d.bin', shard_idx) AS filename, CAST(len(tokens) AS BIGINT) AS num_tokens, "
        f"{ids_digest('tokens')} AS digest FROM sh"
    )


BIGRAM_CTE = (
    "bg AS (SELECT split, x, y, count(*) AS n FROM "
    "(SELECT split, unnest(x) AS x, unnest(y) AS y FROM exy) GROUP BY split, x, y),\n"
    "tr AS (SELECT x, y, n AS c_xy FROM bg WHERE split = 'train'),\n"
    "tx AS (SELECT x, sum(n) AS c_x FROM bg WHERE split = 'train' GROUP BY x),\n"
    f"sc AS (SELECT bg.split, bg.n, -ln((coalesce(tr.c_xy, 0) + {ALPHA}) / (coalesce(tx.c_x, 0) + {ALPHA * BYTE_VOCAB})) AS nll1 "
    "FROM bg LEFT JOIN tr ON bg.x = tr.x AND bg.y = tr.y LEFT JOIN tx ON bg.x = tx.x)"
)

SQL: dict[str, str] = {
    "corpus_scan": "SELECT doc_id, CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes FROM documents WHERE text IS NOT NULL",
    "normalize_v0": (
        "WITH n AS (SELECT doc_id, regexp_replace(replace(replace(text, chr(10), chr(13) || chr(10)), '. ', '.' || chr(13)), "
        "'\\r\\n?', chr(10), 'g') AS t FROM documents)\n"
        "SELECT doc_id, md5(t) AS digest, CAST(octet_length(encode(t)) AS BIGINT) AS n_bytes FROM n"
    ),
    "dedup_exact": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY sha256(text)",
    "dedup_lines": (
        "WITH l AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM "
        "(SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),\n"
        "f AS (SELECT min(doc_id * 1048576 + line_no) AS v, md5(line) AS digest, count(*) AS n_copies FROM l "
        "WHERE line <> '' GROUP BY line)\n"
        "SELECT CAST(v // 1048576 AS BIGINT) AS doc_id, CAST(v % 1048576 AS INTEGER) AS line_no, digest, n_copies FROM f"
    ),
    "dedup_lines_docs": (
        "WITH l AS (SELECT doc_id, unnest(range(len(p))) AS line_no, unnest(p) AS line FROM "
        "(SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)),\n"
        "r AS (SELECT doc_id, line_no, line, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS k FROM l),\n"
        "t AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE k = 1 OR line = ''), '') AS s "
        "FROM r GROUP BY doc_id)\n"
        "SELECT doc_id, CAST(octet_length(encode(s)) AS BIGINT) AS n_bytes, md5(s) AS digest FROM t"
    ),
    "file_corpus": "SELECT doc_id, 'from ' || source AS folder, md5(text) AS digest, true AS has_split FROM documents WHERE text IS NOT NULL",
    "corpus_order": (
        "WITH d AS (SELECT doc_id, lang || CASE WHEN doc_id % 3 > 0 THEN '-' || (doc_id % 3) ELSE '' END AS folder, "
        f"lang = '{TEXT_LANG}' AS as_text, regexp_replace(text, '\\r\\n?', chr(10), 'g') || chr(10) AS file, text FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)\n"
        "SELECT row_number() OVER (ORDER BY folder, CASE WHEN as_text THEN 'doc' ELSE 'part' END, doc_id) - 1 AS rank, "
        "md5(CASE WHEN as_text THEN file ELSE text END) AS digest, "
        "CAST(octet_length(encode(CASE WHEN as_text THEN file ELSE text END)) AS BIGINT) AS n_bytes FROM d"
    ),
    "split_assign": (
        f"SELECT {SPLIT_EXPR} AS split, count(*) AS n_docs, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes "
        "FROM documents GROUP BY 1"
    ),
    "special_split": (
        "WITH src AS (SELECT conv_id, turn, '<|bos|>' || replace(text, chr(10), '<|eos|><|bos|>') || '<|eos|>' AS s "
        "FROM conversations),\n"
        "parts AS (SELECT conv_id, turn, regexp_split_to_array(s, '<\\|bos\\|>|<\\|eos\\|>|<\\|b') AS pieces, "
        "regexp_extract_all(s, '<\\|bos\\|>|<\\|eos\\|>|<\\|b') AS hits FROM src),\n"
        "segs AS (SELECT conv_id, turn, list_filter(flatten(list_transform(pieces, lambda p, i: CASE WHEN i <= len(hits) "
        "THEN [{'is_special': false, 'chunk': p}, {'is_special': true, 'chunk': hits[i]}] "
        "ELSE [{'is_special': false, 'chunk': p}] END)), lambda x: x.is_special OR x.chunk <> '') AS segs FROM parts)\n"
        "SELECT conv_id, turn, CAST(i AS INTEGER) AS seg_idx, seg.is_special AS is_special, seg.chunk AS chunk FROM "
        "(SELECT conv_id, turn, unnest(range(len(segs))) AS i, unnest(segs) AS seg FROM segs)"
    ),
    "pair_counts": (
        f"WITH b AS (SELECT {byte_ids('text')} AS bl FROM documents WHERE text <> ''),\n"
        "k AS (SELECT unnest(list_transform(range(1, len(bl)), lambda i: bl[i] * 256 + bl[i + 1])) AS k FROM b)\n"
        "SELECT CAST(k // 256 AS INTEGER) AS left_id, CAST(k % 256 AS INTEGER) AS right_id, count(*) AS n FROM k GROUP BY k"
    ),
    "bpe_train": q_bpe_train(),
    "bpe_train_long": q_bpe_train_long(),
    "bpe_encode_long": q_bpe_encode_long(),
    "bpe_decode_long": "SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n_bytes, md5(coalesce(text, '')) AS digest FROM documents",
    "bpe_vocab": q_bpe_vocab(),
    "bpe_encode": q_bpe_encode(),
    "bpe_roundtrip": (
        "SELECT lang, count(*) AS n_docs, CAST(0 AS BIGINT) AS n_mismatch FROM documents GROUP BY lang"
    ),
    "compression": q_compression(),
    "token_offsets": f"WITH {TOKENS_CTE}\nSELECT split, doc_id, start, n FROM o",
    "pack_shards": (
        f"WITH {TOKENS_CTE}\n"
        "SELECT split, shard_idx, printf('%s_%05d.bin', split, shard_idx) AS filename, "
        f"CAST(len(tokens) AS BIGINT) AS num_tokens, {ids_digest('tokens')} AS digest FROM sh"
    ),
    "manifest": (
        f"WITH {TOKENS_CTE}\n"
        "SELECT split, count(*) AS n_shards, CAST(sum(len(tokens)) AS BIGINT) AS num_tokens, 'uint16' AS dtype, "
        f"CAST({BYTE_VOCAB} AS INTEGER) AS vocab_size, CAST({SHARD_SIZE} AS INTEGER) AS shard_size FROM sh GROUP BY split"
    ),
    "examples": (
        f"WITH {TOKENS_CTE}\n"
        f"SELECT split, shard_idx, example_idx, {ids_digest('x')} AS x_digest, {ids_digest('y')} AS y_digest FROM exy"
    ),
    "example_at": (
        f"WITH {TOKENS_CTE}\n"
        f"SELECT split, shard_idx, example_idx, {ids_digest('x')} AS x_digest, {ids_digest('y')} AS y_digest FROM exy "
        "WHERE split = 'train' AND shard_idx = 0 ORDER BY example_idx DESC LIMIT 1"
    ),
    "file_examples": (
        f"WITH {TOKENS_CTE}\n"
        f"SELECT split, shard_idx, example_idx, {ids_digest('x')} AS x_digest, {ids_digest('y')} AS y_digest FROM exy"
    ),
    "file_example_at": (
        f"WITH {TOKENS_CTE},\n"
        "ends AS (SELECT split, shard_idx, unnest([min(example_idx), max(example_idx)]) AS example_idx FROM exy GROUP BY split, shard_idx)\n"
        f"SELECT split, shard_idx, example_idx, {ids_digest('x')} AS x_digest, {ids_digest('y')} AS y_digest "
        "FROM ends JOIN exy USING (split, shard_idx, example_idx)"
    ),
    "shard_files": (
        f"WITH {TOKENS_CTE}\n"
        "SELECT split, shard_idx, printf('%s_%05d.bin', split, shard_idx) AS filename, "
        f"CAST(len(tokens) AS BIGINT) AS num_tokens, {ids_digest('tokens')} AS digest FROM sh"
    ),
    "file_job": q_file_job(),
    "perplexity": (
        f"WITH {TOKENS_CTE},\n{BIGRAM_CTE}\n"
        "SELECT 'all' AS corpus, CAST(sum(n) AS BIGINT) AS n_tokens, round(exp(sum(n * nll1) / sum(n)), 6) AS ppl FROM sc"
    ),
    "first_batch": (
        f"WITH {TOKENS_CTE}\n"
        f"SELECT split, shard_idx, CAST(0 AS INTEGER) AS batch_id, CAST(count(*) AS INTEGER) AS n_rows, "
        f"{ids_digest('flatten(list(x ORDER BY example_idx))')} AS x_digest, "
        f"{ids_digest('flatten(list(y ORDER BY example_idx))')} AS y_digest "
        f"FROM exy WHERE split = 'train' AND shard_idx = 0 AND example_idx < {BATCH} GROUP BY split, shard_idx"
    ),
    "token_id_audit": (
        f"WITH {TOKENS_CTE}\n"
        "SELECT split, CAST(min(list_min(x || y)) AS INTEGER) AS min_id, CAST(max(list_max(x || y)) AS INTEGER) AS max_id, "
        f"CAST(count(*) FILTER (WHERE list_min(x || y) < 0 OR list_max(x || y) >= {AUDIT_VOCAB}) AS BIGINT) AS n_bad, "
        f"CAST(count(*) FILTER (WHERE len(x) > {AUDIT_CONTEXT}) AS BIGINT) AS n_too_long FROM "
        f"(SELECT split, list_filter(x, lambda i: i <> {SPACE_ID}) AS x, y FROM exy) GROUP BY split"
    ),
    "bigram_table": (
        f"WITH {TOKENS_CTE}\n"
        "SELECT CAST(x AS INTEGER) AS x, CAST(y AS INTEGER) AS y, count(*) AS n FROM "
        "(SELECT unnest(x) AS x, unnest(y) AS y FROM exy) GROUP BY x, y"
    ),
    "bigram_xent": (
        f"WITH {TOKENS_CTE},\n{BIGRAM_CTE}\n"
        "SELECT split, CAST(sum(n) AS BIGINT) AS n_tokens, round(sum(n * nll1) / sum(n), 6) AS nll, "
        "round(exp(sum(n * nll1) / sum(n)), 6) AS ppl FROM sc GROUP BY split"
    ),
}
