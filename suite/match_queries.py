"""Matching joins and what is made of them, over all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import bands, text
from palimpsest.operators import filters, match
from palimpsest.operators import segments as seg
from palimpsest.operators.copies import text_key
from palimpsest.plans import check, sentences, web
from palimpsest.scratch import stage_packed as stage
from palimpsest.sources import ingest
from palimpsest.sources.tables import spread
from suite.model import with_tables
from suite.registry import query
from suite.text_queries import PLAIN, QUERIES9
from suite.textsql import gram_rows, match_steps, norm

CORPUS = "SELECT * FROM docs WHERE is_active AND is_public"
R2 = "round_even({} * 100, 0) / 100"


def sql_for(body: str, **more: str) -> str:
    """Documents against the other active public documents."""
    return with_tables("docs", body, corp=CORPUS, **match_steps("docs", "corp", True), **more)


BENCH_DOCS = "SELECT item_id AS id, text AS content FROM benchmark"


def bench_sql(body: str, **more: str) -> str:
    """Documents against the benchmark texts."""
    return with_tables("docs", body, corp=BENCH_DOCS, **match_steps("docs", "corp", False), **more)


def prepared(m):
    docs = m.documents()
    return docs, match.Corpus(seg.contents(filters.reference_corpus(docs)))


def bench_corpus(m, k=1):
    items = m.raw("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    return match.Corpus(seg.contents(items), k)


def counted(docs):
    rows = stage(seg.segments(docs).select("src_id", "pos", "clean", "is_noise", "is_excluded"), "segments")
    return seg.counted_segments(rows).withColumn("lid", text_key(F.col("clean")))


@query("J6_exact_containment", sql_for("SELECT src_id, pos, doc_id AS matched_id FROM exact"))
def exact_containment(m):
    docs, corpus = prepared(m)
    segs = counted(docs)
    hits = match.exact_hits(match.distinct_texts(segs), corpus)
    found = segs.select("src_id", "pos", "lid").join(hits, "lid").filter("doc_id <> src_id")
    return found.groupBy("src_id", "pos").agg(F.min("doc_id").alias("matched_id"))


@query(
    "J7_ngram_jaccard",
    sql_for("SELECT src_id, pos, doc_id AS matched_id, inter, score FROM near_all WHERE score > 20"
            " QUALIFY row_number() OVER (PARTITION BY src_id, pos ORDER BY score DESC, doc_id) = 1"),
)
def ngram_jaccard(m):
    """Threshold form: the best overlap above 20 per segment."""
    docs, corpus = prepared(m)
    segs = counted(docs)
    hits = match.bigram_hits(match.distinct_texts(segs), corpus, 20.0)
    found = segs.select("src_id", "pos", "lid").join(hits, "lid").filter("doc_id <> src_id")
    best = found.groupBy("src_id", "pos").agg(
        F.min(F.struct((-F.col("score")).alias("o"), F.col("doc_id").alias("d"), "inter")).alias("b")
    )
    return best.select(
        "src_id", "pos", F.col("b.d").alias("matched_id"), F.col("b.inter").cast("long").alias("inter"),
        (-F.col("b.o")).alias("score"),
    )


@query(
    "J8_best_match",
    sql_for("SELECT src_id, pos, matched_id, is_exact, CAST(score_raw AS double) AS score FROM best"),
)
def best_match(m):
    docs, corpus = prepared(m)
    return match.best_match(counted(docs), corpus).drop("lid")


@query("J6_hot_keys", bench_sql("SELECT src_id, pos, doc_id AS matched_id FROM exact"))
def hot_containment(m):
    """Nearly every key counts as hot, so texts are cut out and compared by equality."""
    segs = counted(m.documents())
    hits = match.exact_hits(match.distinct_texts(segs), bench_corpus(m), hot_df=1)
    found = segs.select("src_id", "pos", "lid").join(hits, "lid")
    return found.groupBy("src_id", "pos").agg(F.min("doc_id").alias("matched_id"))


@query("J8_hot_grams", bench_sql("SELECT src_id, pos, matched_id, is_exact, CAST(score_raw AS double) AS score FROM best"))
def hot_best_match(m):
    """Most shared grams count as hot, so sets are compared by their profiles."""
    return match.best_match(counted(m.documents()), bench_corpus(m), exclude_self=False, hot_df=2).drop("lid")


OVERALL = """SELECT src_id, CAST(sum(CASE WHEN score_raw > 20 THEN n_words ELSE 0 END) AS bigint) AS matched_words,
    CAST(sum(n_words) AS bigint) AS total_words FROM best GROUP BY src_id"""
OVERALL_OUT = f"""SELECT d.id AS src_id, coalesce(o.matched_words, 0) AS matched_words, coalesce(o.total_words, 0) AS total_words,
    CASE WHEN coalesce(o.total_words, 0) > 0 THEN {R2.format('o.matched_words / o.total_words * 100')} ELSE 0 END AS overall_similarity,
    coalesce(m.n, 0) AS total_matched_documents FROM docs d LEFT JOIN overall o ON o.src_id = d.id
    LEFT JOIN (SELECT src_id, count(DISTINCT matched_id) AS n FROM best
      WHERE {R2.format('score_raw')} > 20 AND matched_id IS NOT NULL GROUP BY src_id) m ON m.src_id = d.id"""


def checked(m, min_percent=20.0):
    docs, corpus = prepared(m)
    return docs, check.check_documents(docs, corpus, min_percent=min_percent)


@query("check_documents", sql_for(OVERALL_OUT, overall=OVERALL))
def check_documents(m):
    """Only overlaps above the threshold enter the totals, so the pruned form gives the same."""
    return checked(m)[1].checks.withColumn(
        "total_matched_documents", F.col("total_matched_documents").cast("long")
    )


@query("A4_overall_similarity", bench_sql(f"""SELECT s.src_id, coalesce(o.matched_words, 0) AS matched_words,
    coalesce(o.total_words, 0) AS total_words, CASE WHEN coalesce(o.total_words, 0) > 0
    THEN {R2.format('o.matched_words / o.total_words * 100')} ELSE 0 END AS overall
    FROM (SELECT DISTINCT src_id FROM segs) s LEFT JOIN overall o ON o.src_id = s.src_id""", overall=OVERALL))
def overall_similarity(m):
    scored = check.scored_segments(
        m.documents(), bench_corpus(m), exclude_self=False, min_percent=20.0, texts=False
    )
    return check.overall_similarity(scored)


@query("A5_matched_documents", bench_sql(f"""SELECT src_id, count(DISTINCT matched_id) AS total_matched_documents FROM best
    WHERE {R2.format('score_raw')} > 20 GROUP BY src_id"""))
def matched_documents(m):
    scored = check.scored_segments(
        m.documents(), bench_corpus(m), exclude_self=False, min_percent=20.0, texts=False
    )
    return check.matched_documents(check.match_rows(scored))


@query("F10_highlight_segments", bench_sql(f"""SELECT s.src_id, s.pos, CASE WHEN s.is_excluded THEN 'excluded'
    WHEN r > 60 THEN 'highlight-high' WHEN r > 30 THEN 'highlight-medium' WHEN r > 15 THEN 'highlight-low' ELSE 'plain' END AS display
    FROM (SELECT s.src_id, s.pos, s.is_excluded, coalesce({R2.format('b.score_raw')}, 0) AS r FROM segs s
    LEFT JOIN best b ON b.src_id = s.src_id AND b.pos = s.pos) s"""))
def highlight_segments(m):
    scored = check.scored_segments(
        m.documents(), bench_corpus(m), exclude_self=False, min_percent=15.0, texts=False
    )
    return scored.select("src_id", "pos", bands.highlight(F.col("score"), F.col("is_excluded")).alias("display"))


@query("J11_resolve_source", bench_sql("""SELECT b.src_id, b.pos, t.first_id AS resolved_id FROM best b
    JOIN titles t ON t.id = b.matched_id""", titles="""SELECT item_id AS id,
    min(item_id) OVER (PARTITION BY regexp_extract(text, '^[^ ]+')) AS first_id FROM benchmark"""))
def resolve_source(m):
    """By title, as far as titles are alike: the first word serves as title here."""
    items = m.raw("benchmark").select(F.col("item_id").alias("id"), F.regexp_extract("text", "^[^ ]+", 0).alias("title"))
    scored = match.best_match(counted(m.documents()), bench_corpus(m), exclude_self=False)
    return match.resolve_by_title(scored, items).select("src_id", "pos", "resolved_id")


RESCORE = {
    "named": f"""SELECT DISTINCT src_id, matched_id AS doc_id FROM best
      WHERE {R2.format('score_raw')} > 20 AND matched_id IS NOT NULL""",
    "rx": """SELECT s.src_id, s.pos, min(n.doc_id) AS doc_id FROM counted s JOIN named n ON n.src_id = s.src_id
      JOIN contents d ON d.doc_id = n.doc_id WHERE s.n_words >= 5 AND contains(d.clean, s.clean) GROUP BY ALL""",
    "rn": """SELECT a.* FROM near_all a JOIN named n ON n.src_id = a.src_id AND n.doc_id = a.doc_id
      QUALIFY row_number() OVER (PARTITION BY a.src_id, a.pos ORDER BY a.score DESC, a.doc_id) = 1""",
}


@query("J12_rescore_detail", sql_for(f"""SELECT s.src_id, s.pos, coalesce(x.doc_id, n.doc_id) AS matched_id,
    CASE WHEN x.doc_id IS NOT NULL THEN 100.0::double ELSE coalesce({R2.format('n.score')}, 0) END AS score
    FROM segs s LEFT JOIN rx x ON x.src_id = s.src_id AND x.pos = s.pos
    LEFT JOIN rn n ON n.src_id = s.src_id AND n.pos = s.pos""", **RESCORE))
def rescore_detail(m):
    docs, result = checked(m)
    again = check.rescore_detail(docs, filters.reference_corpus(docs), result.matches)
    return again.select("src_id", "pos", "matched_id", "score")


# --- sentences and pages -----------------------------------------------------------------------
def plain_rows(table: str, key: str) -> str:
    return f"""SELECT {key} AS doc_id, i - 1 AS pos, sents[i] AS sentence, {norm('sents[i]')} AS clean FROM (
      SELECT {key}, sents, unnest(range(1, len(sents) + 1)) AS i FROM (SELECT {key}, {PLAIN} AS sents FROM {table}))"""


@query("J9_sentence_match", with_tables("", """SELECT s.doc_id, s.pos, s.start_position, m.compare_id, m.compare_pos, m.score
    FROM starts s JOIN hits m ON m.doc_id = s.doc_id AND m.pos = s.pos""",
    s1=plain_rows("documents", "doc_id"), c1=plain_rows("benchmark", "item_id"),
    starts="""SELECT doc_id, pos, CAST(coalesce(sum(length(sentence) + 1) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_position FROM s1""",
    sg=gram_rows("s1", "doc_id, pos", 3), cg=gram_rows("c1", "doc_id, pos", 3),
    hits="""SELECT * FROM (SELECT s.doc_id, s.pos, c.doc_id AS compare_id, c.pos AS compare_pos,
      count(*) / (any_value(s.n_grams) + any_value(c.n_grams) - count(*)) * 100 AS score
      FROM sg s JOIN cg c ON c.g = s.g GROUP BY s.doc_id, s.pos, c.doc_id, c.pos) WHERE score > 50
      QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY compare_id, compare_pos) = 1"""))
def sentence_match(m):
    docs = m.documents()
    items = m.raw("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("content"))
    found = sentences.sentence_match(docs, items)
    return found.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), "start_position", "compare_id",
        F.col("compare_pos").cast("long").alias("compare_pos"), "score",
    )


PAGE_TEXT = """trim(regexp_replace(regexp_replace(regexp_replace(html,
    '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g'))"""
SOURCES = f"""SELECT page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title, url,
    {PAGE_TEXT} AS snippet, 'Web' AS source_type FROM pages WHERE {PAGE_TEXT} <> ''"""


@query("S7_web_sources", SOURCES)
def web_sources(m):
    return ingest.web_sources(spread(m.raw("pages")))


@query("U2_union_sources", with_tables("", """SELECT source_type, count(*) AS n FROM (
    SELECT source_type FROM src UNION ALL SELECT 'Reference' FROM benchmark) GROUP BY source_type""", src=SOURCES))
def union_sources(m):
    pages = ingest.web_sources(spread(m.raw("pages")))
    items = m.raw("benchmark").select(
        F.col("item_id").alias("page_id"), F.lit("").alias("title"), F.lit("").alias("url"),
        F.col("text").alias("snippet"), F.lit("Reference").alias("source_type"),
    )
    return ingest.union_sources(pages, items).groupBy("source_type").agg(F.count("*").alias("n"))


WEB = {
    "src": SOURCES,
    "d1": f"SELECT doc_id, {norm('text')} AS clean FROM documents",
    "p1": f"SELECT page_id, {norm('snippet')} AS clean FROM src",
    "dg": gram_rows("d1", "doc_id", 3),
    "pg": gram_rows("p1", "page_id", 3),
    "hits": """SELECT * FROM (SELECT d.doc_id, p.page_id,
      count(*) / (any_value(d.n_grams) + any_value(p.n_grams) - count(*)) * 100 AS score
      FROM dg d JOIN pg p ON p.g = d.g GROUP BY d.doc_id, p.page_id) WHERE score > 20
      QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_id) <= 10""",
}


@query("J10_web_match", with_tables("", "SELECT doc_id, page_id, score FROM hits", **WEB))
def web_match(m):
    docs = m.documents()
    return web.web_matches(docs, ingest.web_sources(spread(m.raw("pages"))))


@query("match_web", with_tables("", f"""SELECT d.doc_id, array_to_string(({QUERIES9})[1:3], ', ') AS query,
    coalesce(h.n, 0) AS total_matches FROM documents d LEFT JOIN (
    SELECT doc_id, count(*) AS n FROM hits GROUP BY doc_id) h ON h.doc_id = d.doc_id""", **WEB))
def match_web(m):
    summary, _ = web.match_web(m.documents(), ingest.web_sources(spread(m.raw("pages"))))
    return summary
