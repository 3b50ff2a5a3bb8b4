"""Registered queries of this subpackage, and their DuckDB SQL where SQL can express them.

Each query applies its operator to its whole table with production parameters.
"""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .common import crc_mod5, table
from .exact_dedup import exact_groups
from .fill_middle import fill_digests
from .near_dedup import near_groups
from .packing import pack
from .paragraph_dedup import repeated_paragraphs, repeated_passages
from .period_runs import run_digests
from .pitman_yor import score_documents
from .quality_fm import fit_quality, score_quality
from .sharding import shard_documents
from .suffix_dedup import cut_digests
from .unit_dedup import repeated_units
from .url_filter import filter_urls
from .winnow import neighbour_fingerprints


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated stretches of words of ``documents``, whatever the line layout: where each stands and where its like stays."""
    return repeated_units(table(spark, sf_dir, "documents")).drop("text_hash", "byte", "n_bytes")


def paragraph_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-equal whole lines of ``documents``: where each removed one stands, which one stays, the cluster's size."""
    return repeated_paragraphs(table(spark, sf_dir, "documents")).select(
        "doc_id", "line", "start", "n_chars", "n_words", "keep_doc_id", "keep_line", "cluster_size")


def passage_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal runs of words of ``documents`` by winnowed marks: where each stands and where its words stay."""
    return repeated_passages(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores of every document."""
    return score_documents(table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every ``pages`` URL by rule, else by the ratio of two character models."""
    return filter_urls(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    """Digests of the BPE ids and of the decoded text of every document."""
    return encode_digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path("byte_bpe_50k.json"))


def op5_winnow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text, and their likeness."""
    return neighbour_fingerprints(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of equal texts of every document."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score for every document."""
    docs = table(spark, sf_dir, "documents")
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    return score_quality(docs, model).select("doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    return near_groups(table(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 15 with row counts at most one apart, equal texts together where they fit."""
    return shard_documents(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin and offset of every piece of every document."""
    return pack(table(spark, sf_dir, "documents"))


def op11_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic word runs of every document, with repeats planted in a tenth of them."""
    return run_digests(table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of every document once earlier strings of 100 bytes are removed."""
    return cut_digests(table(spark, sf_dir, "documents"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document's fill-in-middle form and of the text restored from it."""
    return fill_digests(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of ``corpus_pipeline`` over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_substring_dedup, op2_pitman_yor, op3_url_filter, op4_bpe, op5_winnow, op6_exact_dedup,
                            op7_quality, op8_near_dedup, op9_sharding, op10_packing, op11_period_runs, op12_suffix_dedup, op13_fill_middle,
                            paragraph_lines, passage_marks, pipeline)}

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = "list_filter(regexp_split_to_array({}, '[ \\t\\n\\x0B\\x0C\\r]+'), lambda x: x <> '')"
#: From items w(id, ws) to lnk(a, b), similar pairs by full sets of five-word shingles, and reach(id, c).
_LINKS = """
sh AS (SELECT DISTINCT id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ')
              ELSE array_to_string(ws[i:i + 4], ' ') END AS s
       FROM (SELECT id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT id, count(*) AS n FROM sh GROUP BY id),
pair AS (SELECT x.id AS a, y.id AS b, count(*) AS c FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY 1, 2),
lnk AS (SELECT a, b FROM pair JOIN n p ON p.id = a JOIN n q ON q.id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT a, b FROM lnk UNION ALL SELECT b, a FROM lnk),
reach AS (SELECT id, id AS c FROM w UNION SELECT r.id, e.b FROM reach r JOIN sym e ON r.c = e.a),
comp AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
"""

ORACLES: dict[str, str] = {
    "op6_exact_dedup": f"""
WITH t AS (SELECT doc_id, {_LOWER} AS x FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(x) AS text_sha256
FROM t WINDOW g AS (PARTITION BY x)""",
    "op8_near_dedup": f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, {_WORDS.format(_LOWER)} AS ws FROM documents),{_LINKS}
SELECT w.id AS doc_id, coalesce(n.n, 0) AS n_shingles, comp.c AS component_id, w.id = comp.c AS kept
FROM w JOIN comp USING (id) LEFT JOIN n USING (id)""",
    "paragraph_lines": f"""
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text,
                            generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
p AS (SELECT doc_id, line, length(text) AS n_chars, {_WORDS.format(_LOWER)} AS ws,
             coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY line
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
w AS (SELECT doc_id * 100000 + line AS id, * FROM p WHERE len(ws) >= 20),{_LINKS},
k AS (SELECT c, count(*) AS cluster_size FROM comp GROUP BY c)
SELECT w.doc_id, CAST(w.line AS INTEGER) AS line, CAST(w.start AS INTEGER) AS start, CAST(w.n_chars AS INTEGER) AS n_chars,
       CAST(len(w.ws) AS INTEGER) AS n_words, comp.c // 100000 AS keep_doc_id, CAST(comp.c % 100000 AS INTEGER) AS keep_line,
       k.cluster_size
FROM w JOIN comp USING (id) JOIN k USING (c) WHERE comp.c <> w.id""",
    "op12_suffix_dedup": """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(x, 2 * i + 1, 200)) AS s FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - 99)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
b AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM b),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS e FROM g GROUP BY doc_id, g),
gaps AS (SELECT doc_id, coalesce(lag(e) OVER o, 0) AS a, a AS e FROM spans WINDOW o AS (PARTITION BY doc_id ORDER BY a)
         UNION ALL SELECT doc_id, max(e), NULL FROM spans GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(x, 2 * a + 1, 2 * (coalesce(e, len(x) // 2) - a)), '' ORDER BY a) AS k FROM gaps JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, CAST(sum(e - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, len(x) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(k, x))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_fill_middle": """
WITH h AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
d AS (SELECT doc_id, text, length(text) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
             CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM h),
c AS (SELECT doc_id, text, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                        ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
FROM p""",
}
