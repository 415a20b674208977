"""Texts, pages, conversations and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators.lines import drop_repeated_lines
from tidemill.operators.neighbours import nearest_vectors, recall_of
from tidemill.operators.pages import page_text
from tidemill.operators.turns import PART, assemble
from tidemill.sources.tables import load


def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents less the lines that an earlier document has."""
    return drop_repeated_lines(load(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of web pages without tags and without the blocks that a site repeats."""
    return page_text(load(spark, sf_dir, "pages"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as transcripts, with their missing turns and roles that speak twice."""
    return assemble(load(spark, sf_dir, "conversations"))


def vector_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten vectors most like each one whose id 50 divides, by cosine, of all vectors; exact."""
    vectors = load(spark, sf_dir, "embeddings")
    found = nearest_vectors(vectors.where("vec_id % 50 = 0"), vectors, 10, exact=True)
    return found.select("query_id", "rank", "vec_id", F.round("cosine", 6).alias("cosine"))


def vector_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the same queries there are, and whether the search that probes a few cells only finds nine in ten of their true neighbours."""
    vectors = load(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 50 = 0")
    return recall_of(nearest_vectors(queries, vectors, 10), nearest_vectors(queries, vectors, 10, exact=True)).select("queries", (F.col("recall") >= 0.9).alias("reached"))


QUERIES = {"repeated_lines": repeated_lines, "page_text": pages, "conversation_parts": conversations, "vector_top_k": vector_top_k, "vector_recall": vector_recall}

_BLOCK = "address|article|aside|blockquote|body|br|caption|center|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|legend|li|main|menu|nav|ol|option|p|pre|section|select|summary|table|tbody|td|textarea|tfoot|th|thead|tr|ul"

SQL = {
    "repeated_lines": r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
        t AS (SELECT *, trim(line, ' ' || chr(9)) AS plain FROM l), c AS (SELECT plain, min(doc_id) AS first, count(DISTINCT doc_id) AS n FROM t WHERE plain <> '' GROUP BY plain HAVING n > 1),
        m AS (SELECT t.*, first IS NOT NULL AND first < doc_id AS gone FROM t LEFT JOIN c USING (plain))
        SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped FROM m GROUP BY doc_id""",
    "page_text": rf"""WITH r AS (SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
          regexp_replace(regexp_replace(html, '<!--.*?(-->|$)', '', 'gs'), '<(script|style|title)[^>]*>.*?(</(script|style|title)[^>]*>|$)', '', 'gsi') AS h FROM pages),
        b AS (SELECT page_id, host, unnest(string_split(regexp_replace(regexp_replace(regexp_replace(h, '</?({_BLOCK})(\s[^>]*)?/?(>|$)', chr(1), 'gi'), '</?[a-zA-Z][^>]*(>|$)', '', 'g'), '<[!?/][^>]*(>|$)', '', 'g'), chr(1))) AS raw,
          generate_subscripts(string_split(regexp_replace(regexp_replace(regexp_replace(h, '</?({_BLOCK})(\s[^>]*)?/?(>|$)', chr(1), 'gi'), '</?[a-zA-Z][^>]*(>|$)', '', 'g'), '<[!?/][^>]*(>|$)', '', 'g'), chr(1)), 1) AS k FROM r),
        u AS (SELECT page_id, host, k, trim(regexp_replace(replace(replace(replace(replace(regexp_replace(raw, '&amp;?', '&', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '\s+', ' ', 'g')) AS block FROM b),
        v AS (SELECT * FROM u WHERE block <> ''), p AS (SELECT host, count(DISTINCT page_id) AS of FROM r GROUP BY host),
        c AS (SELECT host, block FROM v JOIN p USING (host) GROUP BY host, block HAVING count(DISTINCT page_id) >= 3 AND count(DISTINCT page_id) >= 0.5 * min(of)),
        m AS (SELECT v.*, c.block IS NOT NULL AS gone FROM v LEFT JOIN c ON v.host = c.host AND v.block = c.block)
        SELECT r.page_id, r.host, count(block) AS n_blocks, count(block) FILTER (gone) AS n_boilerplate, coalesce(string_agg(block, chr(10) ORDER BY k) FILTER (NOT gone), '') AS text
        FROM r LEFT JOIN m USING (page_id) GROUP BY r.page_id, r.host""",
    "conversation_parts": f"""WITH r AS (SELECT conv_id, turn, role, text, turn // {PART} AS part, lag(turn) OVER w AS before, lag(role) OVER w AS spoke, lag(role) OVER v AS within FROM conversations
          WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text), v AS (PARTITION BY conv_id, turn // {PART} ORDER BY turn, role, text)),
        s AS (SELECT *, CASE WHEN within IS NULL THEN role || ': ' WHEN within = role THEN ' ' ELSE chr(10) || role || ': ' END || text AS said FROM r)
        SELECT conv_id, part, count(*) AS n_turns, sum(greatest(0, turn - coalesce(before, -1) - 1))::BIGINT AS n_missing, count(*) FILTER (spoke = role) AS n_repeated,
          string_agg(role, ',' ORDER BY turn, role, text) FILTER (within IS NULL OR within <> role) AS roles, string_agg(said, '' ORDER BY turn, role, text) AS transcript FROM s GROUP BY conv_id, part""",
    "vector_top_k": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.e, v.e), 9) AS c FROM v q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id)
        SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank, vec_id, round(c, 6) AS cosine FROM s QUALIFY rank <= 10""",
    "vector_recall": "SELECT count(*) AS queries, true AS reached FROM embeddings WHERE vec_id % 50 = 0",
}
