"""The subpackage's queries, opN_<name>, and their DuckDB forms."""

from __future__ import annotations

from .common import LOWER, UPPER, documents, work_path


def op1_secret_scan(spark, sf_dir):
    from .secret_scan import report, scan

    found, _ = scan(documents(spark, sf_dir).select("doc_id", "text"))
    return report(found)


def op2_decontamination(spark, sf_dir):
    from .decontamination import find_leaks

    return find_leaks(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op3_mixing(spark, sf_dir):
    from .mixing import take_words

    return take_words(documents(spark, sf_dir))


def op4_near_dedup(spark, sf_dir):
    from .near_dedup import near_dedup

    return near_dedup(documents(spark, sf_dir))


def op5_exact_dedup(spark, sf_dir):
    from .exact_dedup import exact_dedup

    return exact_dedup(documents(spark, sf_dir))


def op6_line_dedup(spark, sf_dir):
    from .line_dedup import line_dedup

    return line_dedup(documents(spark, sf_dir))


def op7_suffix_dedup(spark, sf_dir):
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(documents(spark, sf_dir))


def op8_url_filter(spark, sf_dir):
    from .url_filter import filter_urls

    return filter_urls(documents(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op9_quality(spark, sf_dir):
    from .quality import fit, score

    docs = documents(spark, sf_dir)
    return score(docs, fit(docs, documents(spark, sf_dir, "labels")))


def op10_token_files(spark, sf_dir):
    from .token_files import read_tokens, write_tokens

    path = work_path(spark, "tokens")
    write_tokens(documents(spark, sf_dir), path)
    return read_tokens(spark, path)


def op11_collocations(spark, sf_dir):
    from .phrases import collocations

    return collocations(documents(spark, sf_dir).select("lang", "text"))


def op12_centroids(spark, sf_dir):
    from .centroids import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_edit_fingerprints(spark, sf_dir):
    from .edit_embedding import edit_fingerprints

    return edit_fingerprints(documents(spark, sf_dir))


def queries():
    found = (
        op1_secret_scan, op2_decontamination, op3_mixing, op4_near_dedup, op5_exact_dedup, op6_line_dedup, op7_suffix_dedup,
        op8_url_filter, op9_quality, op10_token_files, op11_collocations, op12_centroids, op13_edit_fingerprints,
    )
    return {f.__name__: f for f in found}


_AZ = f"'{UPPER}', '{LOWER}'"

_ASSIGN = r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _op1_kind(no, kind, pattern, group, least):
    """All matches of a kind with their places, from the text between them and their lengths."""
    return f"""
      SELECT doc_id, {no} AS no, '{kind}' AS kind, length(p) AS size, {least} AS least,
        (sum(length(b) + length(m)) OVER w - length(m))::BIGINT AS first, (sum(length(b) + length(m)) OVER w)::BIGINT AS stop
      FROM (SELECT doc_id, unnest(m) AS m, unnest(p) AS p, unnest(b[1:len(m)]) AS b, unnest(range(len(m))) AS i
        FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS p, string_split_regex(t, '{pattern}') AS b FROM t))
      WINDOW w AS (PARTITION BY doc_id ORDER BY i)"""


def _op11_cuts():
    """Every way to cut a phrase of ``w`` in two, with the counts of both parts."""
    return """
      SELECT c.lang, c.w, c.a, k, (1000::HUGEINT * c.a * n // (l.a * r.a::HUGEINT))::BIGINT AS score, l.a AS l, r.a AS r, n
      FROM c CROSS JOIN range(1, 5) t(k) JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.w = c.w[:k] JOIN f r ON r.lang = c.lang AND r.w = c.w[k + 1:] WHERE k < len(c.w)"""


def _op12_round(i: int) -> str:
    """Assigns every vector to its nearest centroid of c{i}; all but the last round move the centroids."""
    step = f"""
d{i} AS MATERIALIZED (SELECT vec_id, no, sum((v.x - c.x) * (v.x - c.x)) AS d FROM v JOIN c{i} c USING (i) GROUP BY vec_id, no),
a{i} AS MATERIALIZED (SELECT vec_id, no, d FROM d{i} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, no) = 1)"""
    moved = f""",
m{i} AS (SELECT no, i, sum(x)::HUGEINT AS s, count(*)::HUGEINT AS n FROM v JOIN a{i} USING (vec_id) GROUP BY no, i),
c{i + 1} AS MATERIALIZED (SELECT c.no, c.i, CASE WHEN n IS NULL THEN x ELSE ((s - ((s % n) + n) % n) // n)::BIGINT END AS x FROM c{i} c LEFT JOIN m{i} m ON m.no = c.no AND m.i = c.i)"""
    return step + moved * (i < 3)


ORACLE_SQL = {
    "op11_collocations": rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?
-
]')) AS piece FROM documents),
s AS (SELECT lang, regexp_extract_all(piece, '[^ 	]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM s GROUP BY lang),
g AS (SELECT lang, unnest(list_transform(range(1, len(ws) - m + 2), lambda i: ws[i:i + m - 1])) AS w FROM s CROSS JOIN range(1, 6) t(m) WHERE len(ws) >= m),
f AS MATERIALIZED (SELECT lang, w, count(*) AS a FROM g GROUP BY lang, w HAVING count(*) >= 100),
c AS (SELECT * FROM f WHERE len(w) > 1),
x AS ({_op11_cuts()}),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, w ORDER BY score, k) = 1),
i AS (SELECT lang, w[2:] AS w, a FROM c UNION ALL SELECT lang, w[:len(w) - 1], a FROM c),
kept AS (SELECT b.*, array_to_string(w, ' ') AS phrase FROM b WHERE NOT EXISTS (FROM i WHERE i.lang = b.lang AND i.w = b.w AND i.a >= b.a))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000""",
    "op12_centroids": f"""
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT vec_id, unnest(q) AS x, unnest(range(64)) AS i FROM q),
first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS no FROM q QUALIFY no < 16),
c0 AS MATERIALIZED (SELECT no, i, x FROM v JOIN first USING (vec_id)),{",".join(map(_op12_round, range(4)))},
h AS (SELECT no, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c3 GROUP BY no)
SELECT vec_id, no::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY no))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256 FROM a3 JOIN h USING (no)""",
    "op1_secret_scan": f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(_op1_kind(*x) for x in ((0, "assign", _ASSIGN, 1, 8), (1, "access", "AKIA[A-Z0-9]+", 0, 16), (2, "hex", "[0-9a-f]+", 0, 32)))}),
f AS (SELECT doc_id, sum((kind = 'assign')::INT)::BIGINT AS n_assign, sum((kind = 'access')::INT)::BIGINT AS n_access, sum((kind = 'hex')::INT)::BIGINT AS n_hex,
  string_agg(kind || ':' || first || ':' || stop, ',' ORDER BY first, no) AS spans FROM raw WHERE size >= least GROUP BY doc_id)
SELECT doc_id, sha256(t) AS blob, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN f USING (doc_id)""",
    "op5_exact_dedup": f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, h AS text_sha256
FROM (SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS h FROM documents)
WINDOW w AS (PARTITION BY h)""",
    "op8_url_filter": f"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN url[instr(url, '://') + 3:] ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(verdict, rh, rp) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/'))
SELECT page_id, host, path,
  (SELECT arg_max(rh || rp, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS rule,
  coalesce((SELECT arg_max(verdict, length(rh || rp)) FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)), 'allow') AS verdict
FROM h""",
}


def oracle_sql():
    return dict(ORACLE_SQL)
