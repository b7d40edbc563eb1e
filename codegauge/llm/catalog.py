"""The registered queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codegauge.llm.common import table
from codegauge.llm.decontamination import contained_items
from codegauge.llm.html_extraction import extract_text
from codegauge.llm.jaccard_join import jaccard_groups
from codegauge.llm.line_dedup import dedup_lines
from codegauge.llm.mixing import mix_slots
from codegauge.llm.nearest import nearest
from codegauge.llm.periodic_runs import periodic_runs
from codegauge.llm.quality import score_quality
from codegauge.llm.repeated_windows import remove_repeated_windows
from codegauge.llm.secret_scan import scan_secrets
from codegauge.llm.spelling_groups import spelling_groups
from codegauge.llm.toxicity import score_toxicity
from codegauge.llm.vector_dedup import near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
#: Distinct five-word shingles of ``ws``; a shorter list of words is one shingle.
_SHINGLES = ("list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] "
             "ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)")


def query(function=None, *, sql: str | None = None):
    """Register a query, with the SQL that gives the same rows where SQL can say it."""
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f
    return keep if function is None else keep(function)


@query
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


@query
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, counts=("n_lines", "n_removed"))


@query
def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


@query(sql=f"""WITH i AS (SELECT item_id, unnest({_SHINGLES}) AS s FROM (SELECT item_id, {_WORDS} AS ws FROM benchmark)),
    n AS (SELECT item_id, count(*) AS n_shingles FROM i GROUP BY 1),
    d AS (SELECT doc_id, unnest({_SHINGLES}) AS s FROM (SELECT doc_id, {_WORDS} AS ws FROM documents))
    SELECT doc_id, item_id, count(*) AS n_shared, n_shingles, count(*) / n_shingles AS containment
    FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_shingles HAVING count(*) / n_shingles >= 0.8""")
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(sql=f"""WITH RECURSIVE rep AS (SELECT coalesce(text, '') AS text, min(doc_id) AS node FROM documents GROUP BY 1),
    s AS (SELECT node, unnest({_SHINGLES}) AS s FROM (SELECT node, {_WORDS} AS ws FROM rep)),
    n AS (SELECT node, count(*) AS n FROM s GROUP BY 1),
    shared AS (SELECT a.node AS x, b.node AS y, count(*) AS n FROM s a JOIN s b ON a.s = b.s AND a.node <> b.node GROUP BY 1, 2),
    link AS (SELECT x, y FROM shared h JOIN n a ON a.node = x JOIN n b ON b.node = y WHERE h.n / (a.n + b.n - h.n) >= 0.8),
    reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
    class AS (SELECT n.node, least(n.node, (SELECT min(y) FROM reach WHERE x = n.node)) AS class_id, (SELECT count(*) FROM link WHERE x = n.node) AS n_links FROM n)
    SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, CASE WHEN c.node IS NULL THEN d.doc_id ELSE c.node END AS copy_of, coalesce(c.n_links, 0) AS n_links
    FROM documents d JOIN rep r ON r.text = coalesce(d.text, '') LEFT JOIN class c ON c.node = r.node""")
def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(table(spark, sf_dir, "documents"))


@query
def op7_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_slots(table(spark, sf_dir, "documents"))


@query
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(sql=f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w)),
    first AS (SELECT k, min(doc_id) AS f FROM win GROUP BY 1),
    gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN first USING (k) WHERE f < doc_id),
    tok AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
    kept AS (SELECT doc_id, count(g.p) AS n_removed, string_agg(word, ' ' ORDER BY p) FILTER (g.p IS NULL) AS left_over
             FROM tok LEFT JOIN gone g USING (doc_id, p) GROUP BY 1)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(left_over, '')) AS kept_sha256
    FROM w LEFT JOIN kept USING (doc_id)""")
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_windows(table(spark, sf_dir, "documents"), with_text=False).drop("kept_text")


#: CRC-32 in SQL: its table from its polynomial, and the checksum of a list of bytes.
_CRC_TABLE = """crc AS (SELECT list(v ORDER BY k) AS tab FROM (SELECT k, list_reduce(list_concat([k], range(8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(k)))"""


def _crc(text: str) -> str:
    size = f"CAST(len(hex(encode({text}))) // 2 AS BIGINT)"
    octets = f"list_transform(range({size}), lambda k: CAST('0x' || substr(hex(encode({text})), 2 * k + 1, 2) AS BIGINT))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), "
            "lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT)")


@query(sql=f"""WITH {_CRC_TABLE},
    d AS (SELECT doc_id, {_WORDS} AS ws, {_crc("CAST(doc_id AS VARCHAR)")} AS h FROM documents, crc),
    g AS (SELECT *, len(ws) AS n, h // 10 AS g FROM d),
    a AS (SELECT *, CASE WHEN n > 0 THEN g % n ELSE 0 END AS a FROM g),
    s AS (SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i:
        ws[1 + CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // (3 + g % 8)) ELSE i END]) ELSE ws END AS ws FROM a),
    w AS (SELECT doc_id, n, unnest(ws) AS word, unnest(range(n)) AS i FROM s),
    eq AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
    stretch AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length
        FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM eq) GROUP BY doc_id, q, island),
    run AS (SELECT doc_id, start, length, min(q) AS period FROM stretch WHERE length >= greatest(6, 4 * q) GROUP BY ALL),
    gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS left_over FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
    r AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed,
        min({{'m': -length, 's': start, 'p': period}}) AS best FROM run GROUP BY 1)
    SELECT s.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, -best.m AS length, best.p AS period,
        1000 * -best.m // best.p AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(left_over, '')) AS collapsed_sha256
    FROM s LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)""")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(table(spark, sf_dir, "documents"), planted=True, details=False)
    return found.drop("starts", "lengths", "periods", "collapsed_text")


@query(sql=f"""WITH RECURSIVE {_CRC_TABLE},
    t AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
    u AS (SELECT doc_id, run, count(*) AS n FROM t GROUP BY 1, 2),
    h AS (SELECT run, n, {_crc("doc_id || ':' || run")} AS h FROM u, crc),
    v AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
    c AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM v WHERE length(word) >= 5 GROUP BY 1 HAVING sum(n) >= 3),
    x AS (SELECT word, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM c)),
    one AS (SELECT a.word, b.word AS near FROM x a JOIN x b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
        UNION SELECT x.word, c.word FROM x JOIN c ON x.rest = c.word UNION SELECT c.word, x.word FROM x JOIN c ON x.rest = c.word),
    b AS (SELECT one.word, count(*) AS n_near, min({{'m': -c.n, 'w': near}}) AS best FROM one JOIN c ON c.word = near GROUP BY 1),
    f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 2 * c.n THEN best.w END AS form, CASE WHEN -best.m >= 2 * c.n THEN -best.m END AS form_n
        FROM c LEFT JOIN b USING (word)),
    way(word, here) AS (SELECT word, word FROM f UNION ALL SELECT way.word, f.form FROM way JOIN f ON f.word = way.here WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, way.here AS root, f.n, f.n_near, f.form_n FROM f JOIN way ON way.word = f.word JOIN f last ON last.word = way.here WHERE last.form IS NULL""")
def op12_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"), slips=True)


@query(sql="""WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
    link AS (SELECT a.vec_id AS x, b.vec_id AS y FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
        AND list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(x, y) AS (SELECT x, y FROM link UNION SELECT r.x, l.y FROM reach r JOIN link l ON l.x = r.y),
    n AS (SELECT x, count(*) AS n_links FROM link GROUP BY 1), low AS (SELECT x, min(y) AS y FROM reach GROUP BY 1)
    SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low.y, vec_id)) AS component_id, vec_id <= coalesce(low.y, vec_id) AS kept
    FROM v LEFT JOIN n ON n.x = vec_id LEFT JOIN low ON low.x = vec_id""")
def op13_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
