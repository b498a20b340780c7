"""The subpackage's registered queries: each applies its operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, decontaminate, html_extract, langid, line_dedup, merkle, mpeg_audio, near_dedup, packing, substring_dedup, token_counts, toxicity, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_digest(_table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mpeg_audio.media_digest(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_report(_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(_table(spark, sf_dir, "documents"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proof_report(_table(spark, sf_dir, "documents"))


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(_table(spark, sf_dir, "embeddings"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_html_extraction, op2_line_dedup, op3_toxicity, op4_best_fit_packing, op5_decontamination, op6_mpeg_audio, op7_language_id, op8_near_dedup, op9_substring_dedup, op10_url_filters, op11_merkle_manifest, op12_centroid_clustering, op13_token_counts)
}

_LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_KEY = _LOW.format("trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")
_WORDS = "regexp_extract_all(" + _LOW.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _enc(v: str) -> str:
    return f"coalesce(strlen({v}) || ':' || {v}, '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_enc(v) for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", f"CAST({n_chars} AS VARCHAR)", "text")) + ")"


#: crc32 of a text of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({}, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)), 4294967295)"
#: All levels of the trees of ``start``(tree, hs): pairs of hashes become one, a single one becomes its own hash.
_LEVELS = "SELECT tree, 0 AS level, hs FROM {0} UNION ALL SELECT tree, level + 1, list_transform(range(1, (len(hs) + 1) // 2 + 1), lambda i: sha256(hs[2 * i - 1] || coalesce(hs[2 * i], ''))) FROM {1} WHERE len(hs) > 1"
#: A node's sibling on a level, behind the side it is on.
_STEP = "CASE WHEN (place >> level) & 1 = 1 THEN 'L' ELSE 'R' END || coalesce(hs[xor(place >> level, 1) + 1], '')"

_KEPT = "SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64"
_NEAREST = "SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM (SELECT p.r, m.c, list_sum(list_transform(list_zip(p.v, m.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM points p, {0} m) GROUP BY r"


def _clusters_sql(rounds: int = 10, k: int = 8) -> str:
    parts = [
        f"kept AS MATERIALIZED ({_KEPT}), points AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id, v) AS r, vec_id, v FROM kept)",
        f"m0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1 AS c, v FROM points QUALIFY c < {k})",
    ]
    for i in range(rounds):
        parts += [
            f"a{i} AS MATERIALIZED ({_NEAREST.format(f'm{i}')})",
            f"s{i} AS (SELECT c, j, sum(v[j])::BIGINT AS s, count(*) AS n FROM a{i} JOIN points USING (r), (SELECT unnest(range(1, 65)) AS j) GROUP BY c, j)",
            f"m{i + 1} AS MATERIALIZED (SELECT m.c, coalesce(u.v, m.v) AS v FROM m{i} m LEFT JOIN (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY j) AS v FROM s{i} GROUP BY c) u ON u.c = m.c)",
        ]
    return (
        f"WITH {', '.join(parts)}, a{rounds} AS MATERIALIZED ({_NEAREST.format(f'm{rounds}')}) "
        f"SELECT vec_id, CAST(a.c AS INTEGER) AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.v, ',')) AS centroid_sha256 "
        f"FROM a{rounds} a JOIN points USING (r) JOIN m{rounds} m ON m.c = a.c"
    )


ORACLES: dict[str, str] = {
    "op2_line_dedup": f"""
        WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        numbered AS (SELECT row_number() OVER () AS r, doc_id, lines FROM base),
        keys AS (SELECT DISTINCT r, {_KEY.format('line')} AS k FROM (SELECT r, unnest(lines) AS line FROM numbered)),
        frequent AS (SELECT coalesce(list(k), []) AS ks FROM (SELECT k FROM keys WHERE length(k) >= 1 GROUP BY k HAVING count(*) >= 10)),
        cut AS (SELECT doc_id, lines, list_filter(lines, lambda x: NOT list_contains(ks, {_KEY.format('x')})) AS kept FROM numbered, frequent)
        SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
               sha256(coalesce(array_to_string(kept, chr(10)), '')) AS kept_sha256
        FROM cut""",
    "op5_decontamination": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        b AS (SELECT item_id, {_WORDS} AS ws FROM benchmark),
        sized AS (SELECT item_id, ws, least(13, len(ws)) AS m FROM b WHERE len(ws) > 0),
        windows AS (SELECT DISTINCT item_id, m, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT item_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM sized)),
        sizes AS (SELECT DISTINCT m FROM windows),
        places AS (SELECT doc_id, m, i, array_to_string(ws[i:i + m - 1], ' ') AS g FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, sizes WHERE len(ws) >= m)),
        hits AS (SELECT DISTINCT doc_id, i, m, item_id FROM places JOIN windows USING (m, g)),
        words AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits WHERE item_id IS NOT NULL GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(len(ids), 0) AS BIGINT) AS n_items, sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
               coalesce(n, 0) > 0 AND 20 * coalesce(n, 0) >= len(ws) AS contaminated
        FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id""",
    "op10_url_filters": f"""
        WITH rules(verdict, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
        parts AS (SELECT page_id, coalesce({_LOW.format("regexp_extract(url, '://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
        numbered AS (SELECT row_number() OVER () AS r, * FROM parts),
        best AS (SELECT r, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
                 FROM numbered JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM numbered LEFT JOIN best USING (r)""",
    "op11_merkle_manifest": f"""
        WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf('n_chars')} AS leaf, CASE WHEN {_CRC.format('CAST(doc_id AS VARCHAR)')} % 7 = 0 THEN {_leaf('n_chars + 1')} ELSE {_leaf('n_chars')} END AS given FROM documents),
        placed AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM d),
        grown AS (SELECT lang AS tree, list(leaf ORDER BY place) AS hs FROM placed GROUP BY lang),
        levels AS ({_LEVELS.format('grown', 'levels')}),
        subroots AS MATERIALIZED (SELECT tree AS lang, hs[1] AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS place FROM levels WHERE len(hs) = 1),
        planted AS (SELECT 0 AS tree, list(subroot ORDER BY place) AS hs FROM subroots),
        tops AS ({_LEVELS.format('planted', 'tops')}),
        upper AS (SELECT lang, subroot, (SELECT hs[1] FROM tops WHERE len(hs) = 1) AS root, list({_STEP} ORDER BY level) FILTER (len(hs) > 1) AS steps FROM subroots, tops GROUP BY lang, subroot),
        lower AS (SELECT doc_id, placed.lang, leaf, given, place, list({_STEP} ORDER BY level) FILTER (len(hs) > 1) AS steps FROM placed JOIN levels ON placed.lang IS NOT DISTINCT FROM tree GROUP BY ALL),
        proofs AS (SELECT doc_id, leaf, subroot, root, given, list_concat(coalesce(w.steps, []), coalesce(u.steps, [])) AS steps FROM lower w JOIN upper u ON w.lang IS NOT DISTINCT FROM u.lang),
        folded AS (SELECT *, list_reduce(list_prepend(given, steps), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root FROM proofs)
        SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(steps, lambda s: s[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM folded""",
    "op12_centroid_clustering": _clusters_sql(),
}
