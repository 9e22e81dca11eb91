"""Text expressions, quality and machine-text scores over the whole document table."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import ai, bands, fixed, quality, text
from palimpsest.operators import segments as seg
from palimpsest.plans import ai as ai_plan
from palimpsest.plans import quality as quality_plan
from palimpsest.plans import sentences as sentence_plan
from palimpsest.sources.tables import spread
from suite.model import with_tables
from suite.registry import query
from suite.textsql import SEG_RAW, SEGS, any_of, cut, n_words, norm, quoted

WS = r"[\s\x0B\x{85}\p{Z}]"


def docs_of(m):
    return spread(m.raw("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content")))


def titled(m):
    return docs_of(m).withColumn("title", F.concat(F.lit("doc-"), F.col("id").cast("string")))


@query("X1_normalize", f"SELECT doc_id AS id, {norm('text')} AS clean FROM documents")
def normalize(m):
    return docs_of(m).select("id", text.normalize(F.col("content")).alias("clean"))


@query("X2_cut_bibliography", f"SELECT doc_id AS id, {cut('text')} AS body FROM documents")
def cut_bibliography(m):
    return docs_of(m).select("id", text.cut_bibliography(F.col("content")).alias("body"))


# The keyword lists are parameters; words of the given texts make the cut take place.
LATE_WORDS = ["the of", "des", "und", "que"]


def cut_with(column: str, words: list[str]) -> str:
    low = f"lower({column})"
    found = []
    for k in words:
        at = f"instr(reverse({low}), {quoted(k[::-1])})"
        start = f"(length({low}) - {len(k)} + 1 - {at})"
        found.append(f"CASE WHEN {at} > 0 AND {start} > length({column}) * 0.7::double THEN {start} END")
    best = f"greatest({', '.join(found)})"
    return f"CASE WHEN {best} IS NULL THEN {column} ELSE substr({column}, 1, CAST({best} AS int)) END"


@query("X2_cut_at_given_words", f"SELECT doc_id AS id, {cut_with('text', LATE_WORDS)} AS body FROM documents")
def cut_at_given_words(m):
    return docs_of(m).select("id", text.cut_bibliography(F.col("content"), LATE_WORDS).alias("body"))


SOURCE = "SELECT doc_id AS id, text AS content FROM documents"


@query(
    "X3_segments",
    with_tables("", "SELECT src_id, pos, raw FROM seg_raw", src=SOURCE, seg_raw=SEG_RAW.replace("SOURCE", "src")),
)
def segment_rows(m):
    return seg.segments(docs_of(m)).select("src_id", "pos", "raw")


@query(
    "X4_segment_class",
    with_tables("", f"""SELECT src_id, pos, n_words, is_noise, is_excluded,
    CASE WHEN n_words = 0 THEN NULL WHEN is_noise THEN {quoted(fixed.REASON_TOO_SHORT)}
    WHEN is_excluded THEN {quoted(fixed.REASON_COMMON_PHRASE)} END AS reason FROM segs""",
    src=SOURCE, seg_raw=SEG_RAW.replace("SOURCE", "src"), segs=SEGS),
)
def segment_class(m):
    return seg.segments(docs_of(m)).select(
        "src_id", "pos", F.col("n_words").cast("long").alias("n_words"), "is_noise", "is_excluded", "reason"
    )


GIVEN_PHRASES = ["of the", "que des", "und der"]


@query(
    "X4_class_by_given_phrases",
    with_tables("", """SELECT src_id, pos, is_excluded FROM segs""", src=SOURCE,
    seg_raw=SEG_RAW.replace("SOURCE", "src"),
    segs=f"""SELECT src_id, pos, {n_words('clean')} >= 3 AND {any_of('clean', GIVEN_PHRASES)} AS is_excluded
    FROM (SELECT *, {norm('raw')} AS clean FROM seg_raw)"""),
)
def class_by_given_phrases(m):
    return seg.segments(docs_of(m), phrases=GIVEN_PHRASES).select("src_id", "pos", "is_excluded")


TOKENS = "list_filter(string_split(text, ' '), lambda x: x <> '')"


@query("X5_tokenize", f"SELECT doc_id AS id, array_to_string({TOKENS}, '|') AS tokens, len({TOKENS}) AS n FROM documents")
def tokenize(m):
    tokens = text.tokenize(F.col("content"))
    return docs_of(m).select("id", F.array_join(tokens, "|").alias("tokens"), F.size(tokens).cast("long").alias("n"))


def gram_count(n: int) -> str:
    parts = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    return f"""SELECT id, len(gs) AS n, coalesce(md5(array_to_string(list_sort(gs), '|')), '') AS digest FROM (
      SELECT id, CASE WHEN len(t) >= {n} THEN list_distinct(list_transform(range(1, len(t) - {n} + 2), lambda i: {parts})) ELSE [] END AS gs
      FROM (SELECT doc_id AS id, list_filter(string_split({norm('text')}, ' '), lambda x: x <> '') AS t FROM documents))"""


def gram_rows(m, n):
    grams = docs_of(m).select("id", text.normalize(F.col("content")).alias("clean"))
    grams = grams.select("id", text.tokenize(F.col("clean")).alias("tokens"))
    grams = grams.select("id", text.ngrams_of_tokens(F.col("tokens"), n).alias("g"))
    return grams.select(
        "id", F.size("g").cast("long").alias("n"), F.md5(F.array_join(F.array_sort("g"), "|")).alias("digest")
    )


@query("X6_bigrams", gram_count(2))
def bigrams(m):
    return gram_rows(m, 2)


@query("X6_trigrams", gram_count(3))
def trigrams(m):
    return gram_rows(m, 3)


SENTENCES = (
    "list_filter(string_split(regexp_replace(text, '([.!?])" + WS + "+', '\\1' || chr(1), 'g'), chr(1)),"
    " lambda s: length(s) > 10)"
)


@query(
    "X7_sentences_lookbehind",
    f"SELECT doc_id AS id, len({SENTENCES}) AS n, array_to_string({SENTENCES}, chr(2)) AS sentences FROM documents",
)
def sentences_lookbehind(m):
    pieces = text.sentences(F.col("content"))
    return docs_of(m).select(
        "id", F.size(pieces).cast("long").alias("n"), F.array_join(pieces, "\x02").alias("sentences")
    )


PLAIN = (
    "list_filter(list_transform(string_split_regex(text, '[.!?]'), lambda s: regexp_replace(s, '^"
    + WS + "+|" + WS + "+$', '', 'g')), lambda s: length(s) > 20)"
)


@query("X8_sentences_plain", f"SELECT doc_id AS id, len({PLAIN}) AS n, array_to_string({PLAIN}, chr(2)) AS sentences FROM documents")
def sentences_plain(m):
    pieces = text.sentences_plain(F.col("content"))
    return docs_of(m).select(
        "id", F.size(pieces).cast("long").alias("n"), F.array_join(pieces, "\x02").alias("sentences")
    )


QUERIES9 = """list_transform(list_filter(list_transform(
    list_filter(string_split_regex(text, '[.!?]'), lambda s: s <> '')[1:5],
    lambda s: list_filter(string_split(s, ' '), lambda x: x <> '')), lambda w: len(w) >= 5),
    lambda w: array_to_string(w[1:7], ' '))"""


@query(
    "X9_search_queries",
    f"SELECT id, array_to_string(q, '|') AS queries, array_to_string(q[1:3], ', ') AS line FROM (SELECT doc_id AS id, {QUERIES9} AS q FROM documents)",
)
def search_queries(m):
    found = docs_of(m).select("id", text.search_queries(F.col("content")).alias("q"))
    return found.select("id", F.array_join("q", "|").alias("queries"), text.query_line(F.col("q")).alias("line"))


PARAGRAPHS = "list_filter(string_split_regex(text, '\\r\\n\\r\\n|\\n\\n'), lambda p: p <> '')"


@query("X10_paragraphs", f"SELECT doc_id AS id, len({PARAGRAPHS}) AS n FROM documents")
def paragraphs(m):
    return docs_of(m).select("id", F.size(text.paragraphs(F.col("content"))).cast("long").alias("n"))


# --- quality -------------------------------------------------------------------------------
def occurrences(phrases) -> str:
    return " + ".join(f"(length(low) - length(replace(low, {quoted(p)}, ''))) // {len(p)}" for p in phrases)


TERMS = "[" + ", ".join(quoted(t) for t in fixed.ACADEMIC_TERMS) + "]"
FEATURES = f"""SELECT *, CASE WHEN sentence_count > 0 THEN word_count / sentence_count ELSE 0 END AS avg_sentence_length,
    CASE WHEN paragraph_count > 0 THEN word_count / paragraph_count ELSE 0 END AS avg_paragraph_length,
    CASE WHEN word_count > 0 THEN unique_words / word_count ELSE 0 END AS lexical_diversity,
    least(100, CASE WHEN word_count > 0 THEN unique_words / word_count ELSE 0 END * 200) AS richness,
    CASE WHEN sentence_count = 0 THEN 0 WHEN n_pieces / sentence_count BETWEEN 15 AND 25 THEN 80
    WHEN n_pieces / sentence_count BETWEEN 10 AND 30 THEN 60 ELSE 40 END AS readability,
    least(100, CASE WHEN paragraph_count > 0 THEN transitions / paragraph_count ELSE 0 END * 50) AS coherence
    FROM (SELECT doc_id, len(words) AS word_count, len(list_distinct(words)) AS unique_words,
      len(parts) AS paragraph_count, len(sents) AS sentence_count, len(string_split(content, ' ')) AS n_pieces,
      true AS has_title, {any_of("lower(coalesce(parts[1], ''))", fixed.INTRODUCTION_KEYWORDS)} AS has_introduction,
      {any_of("lower(coalesce(parts[-1], ''))", fixed.CONCLUSION_KEYWORDS)} AS has_conclusion,
      {any_of('low', fixed.REFERENCE_KEYWORDS)} AS has_references,
      {occurrences(fixed.TRANSITION_PHRASES)} AS transitions,
      list_filter({TERMS}, lambda t: contains(low, t)) AS academic_terms FROM (
        SELECT doc_id, text AS content, lower(text) AS low, {TOKENS} AS words,
        {PARAGRAPHS} AS parts, {SENTENCES} AS sents FROM documents))"""


def issue_sql(name: str, test: str) -> str:
    kind, severity, description, _ = fixed.ISSUES[name]
    told = quoted(description)
    if "%d" in description:
        before, after = description.split("%d")
        told = f"{quoted(before)} || word_count || {quoted(after)}"
    return f"CASE WHEN {test} THEN {quoted(kind)} || '/' || {quoted(severity)} || '/' || {told} END"


ISSUES = "list_filter([" + ", ".join(
    issue_sql(name, test)
    for name, test in {
        "no_title": "NOT has_title", "no_introduction": "NOT has_introduction",
        "no_conclusion": "NOT has_conclusion", "no_references": "NOT has_references",
        "too_short": "word_count < 500", "poor_vocabulary": "richness < 30",
        "short_sentences": "avg_sentence_length < 10", "long_sentences": "avg_sentence_length > 30",
    }.items()
) + "], lambda x: x IS NOT NULL)"

SCORED = f"""SELECT *, CAST(trunc((readability + coherence + richness) / 3) AS int) AS content_score,
    {ISSUES} AS issues,
    15 * has_title::int + 20 * has_introduction::int + 20 * has_conclusion::int + 15 * has_references::int
    + 10 * (paragraph_count >= 3)::int + 10 * (word_count >= 500)::int
    + 10 * (avg_sentence_length BETWEEN 15 AND 25)::int AS format_score FROM features"""

TOLD = {k: v.split("%d") for k, v in fixed.SUGGESTIONS.items()}
SUGGESTIONS = f"""list_filter([
    CASE WHEN severe > 0 THEN {quoted(TOLD['severe_issues'][0])} || severe || {quoted(TOLD['severe_issues'][1])} END,
    CASE WHEN word_count < 1000 THEN {quoted(TOLD['longer'][0])} END,
    CASE WHEN len(academic_terms) < 5 THEN {quoted(TOLD['more_terms'][0])} END,
    CASE WHEN coherence < 60 THEN {quoted(TOLD['coherence'][0])} END,
    CASE WHEN NOT has_references THEN {quoted(TOLD['references'][0])} END], lambda x: x IS NOT NULL)"""


def features_of(m):
    return quality_plan.features(titled(m))


def q_sql(body: str) -> str:
    return with_tables("", body, features=FEATURES, scored=SCORED)


@query("A7_lexical_stats", q_sql("SELECT doc_id, word_count, unique_words, lexical_diversity, richness FROM features"))
def lexical_stats(m):
    return features_of(m).select(
        "doc_id", F.col("word_count").cast("long").alias("word_count"),
        F.col("unique_words").cast("long").alias("unique_words"), "lexical_diversity", "richness",
    )


@query(
    "X11_keyword_flags",
    q_sql("SELECT doc_id, has_introduction, has_conclusion, has_references, array_to_string(academic_terms, '|') AS terms FROM features"),
)
def keyword_flags(m):
    return features_of(m).select(
        "doc_id", "has_introduction", "has_conclusion", "has_references", F.array_join("academic_terms", "|").alias("terms")
    )


GIVEN_WORDS = ["the", "des", "und", "que", "of"]


@query(
    "X11_given_keywords",
    f"""SELECT doc_id, {any_of("lower(text)", GIVEN_WORDS)} AS has_any,
    array_to_string(list_filter([{', '.join(map(quoted, GIVEN_WORDS))}], lambda w: contains(lower(text), w)), '|') AS found,
    {occurrences(GIVEN_WORDS).replace('low', 'lower(text)')} AS n FROM documents""",
)
def given_keywords(m):
    low = F.lower("content")
    return docs_of(m).select(
        F.col("id").alias("doc_id"), quality.has_any(F.col("content"), GIVEN_WORDS).alias("has_any"),
        F.array_join(quality.present(low, GIVEN_WORDS), "|").alias("found"),
        quality.occurrences(low, GIVEN_WORDS).cast("long").alias("n"),
    )


@query("X12_readability", q_sql("SELECT doc_id, sentence_count, CAST(readability AS double) AS readability FROM features"))
def readability(m):
    return features_of(m).select("doc_id", F.col("sentence_count").cast("long").alias("sentence_count"), "readability")


@query("X13_coherence", q_sql("SELECT doc_id, transitions, CAST(coherence AS double) AS coherence FROM features"))
def coherence(m):
    return features_of(m).select("doc_id", F.col("transitions").cast("long").alias("transitions"), "coherence")


@query(
    "X14_format_score",
    q_sql("""SELECT doc_id, CAST(format_score AS bigint) AS format_score, format_score >= 60 AS has_proper_structure,
    avg_sentence_length, avg_paragraph_length FROM scored"""),
)
def format_score(m):
    return quality_plan.scores(features_of(m)).select(
        "doc_id", F.col("format_score").cast("long").alias("format_score"), "has_proper_structure",
        "avg_sentence_length", "avg_paragraph_length",
    )


@query("X15_content_score", q_sql("SELECT doc_id, CAST(content_score AS bigint) AS content_score FROM scored"))
def content_score(m):
    return quality_plan.scores(features_of(m)).select("doc_id", F.col("content_score").cast("long").alias("content_score"))


LEVEL = f"""CASE WHEN q >= 85 THEN {quoted('Rất tốt')} WHEN q >= 70 THEN {quoted('Tốt')}
    WHEN q >= 50 THEN {quoted('Trung bình')} ELSE {quoted('Kém')} END"""
QSCORE = "format_score * CAST(0.4 AS double) + content_score * CAST(0.6 AS double)"


@query("X16_quality_score", q_sql(f"SELECT doc_id, q AS quality_score, {LEVEL} AS quality_level FROM (SELECT doc_id, {QSCORE} AS q FROM scored)"))
def quality_score(m):
    return quality_plan.scores(features_of(m)).select("doc_id", "quality_score", "quality_level")


@query("X17_quality_issues", q_sql("SELECT doc_id, array_to_string(issues, '|') AS issues FROM scored"))
def quality_issues(m):
    told = F.transform("issues", lambda i: F.concat_ws("/", i["type"], i["severity"], i["description"]))
    return quality_plan.scores(features_of(m)).select("doc_id", F.array_join(told, "|").alias("issues"))


SEVERE = "len(list_filter(issues, lambda i: contains(i, '/High/')))"


@query("X18_quality_suggestions", q_sql(f"SELECT doc_id, array_to_string({SUGGESTIONS}, '|') AS suggestions FROM (SELECT *, {SEVERE} AS severe FROM scored)"))
def quality_suggestions(m):
    return quality_plan.scores(features_of(m)).select("doc_id", F.array_join("suggestions", "|").alias("suggestions"))


PHRASES = """SELECT doc_id, word, n, first_at FROM (
    SELECT doc_id, word, count(*) AS n, min(i) - 1 AS first_at FROM (
      SELECT doc_id, parts[i] AS word, i FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
      FROM (SELECT doc_id, string_split(text, ' ') AS parts FROM documents)))
    WHERE word <> '' GROUP BY doc_id, word)
    QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_at) <= 10"""


@query("W2_key_phrases", f"SELECT doc_id, word, n, first_at FROM ({PHRASES})")
def key_phrases(m):
    return quality_plan.key_phrase_rows(docs_of(m)).withColumn("first_at", F.col("first_at").cast("long"))


@query(
    "score_quality",
    with_tables("", f"""SELECT s.doc_id, CAST(format_score AS bigint) AS format_score, CAST(content_score AS bigint) AS content_score,
    {QSCORE} AS quality_score, len(issues) AS n_issues, coalesce(p.phrases, '') AS phrases
    FROM scored s LEFT JOIN (SELECT doc_id, string_agg(word, '|' ORDER BY n DESC, first_at) AS phrases FROM kp GROUP BY doc_id) p
    ON p.doc_id = s.doc_id""", features=FEATURES, scored=SCORED, kp=PHRASES),
)
def score_quality(m):
    return quality_plan.score_quality(titled(m)).select(
        "doc_id", F.col("format_score").cast("long").alias("format_score"),
        F.col("content_score").cast("long").alias("content_score"), "quality_score",
        F.size("issues").cast("long").alias("n_issues"), F.array_join("key_phrases", "|").alias("phrases"),
    )


# --- machine-text rules --------------------------------------------------------------------
AI_SCORE = f"""CASE WHEN {n_words('s')} < 5 THEN 10.0 ELSE least(98.0, 30
    + CASE WHEN {n_words('s')} BETWEEN 16 AND 24 THEN 15 ELSE 0 END
    + {' + '.join(f"CASE WHEN contains(lower(s), {quoted(t)}) THEN 5 ELSE 0 END" for t in fixed.AI_TRANSITIONS)}
    + CASE WHEN regexp_matches(s, '[a-z]{{10,}}') THEN 0 ELSE 5 END) END"""
AI_ROWS = f"""SELECT doc_id, i - 1 AS pos, s, CAST({AI_SCORE} AS double) AS score FROM (
    SELECT doc_id, i, sents[i] AS s FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS i
    FROM (SELECT doc_id, {SENTENCES} AS sents FROM documents)))"""


@query("X19_ai_sentence_score", f"SELECT doc_id, pos, s AS sentence, score, score > 60 AS is_likely_ai FROM ({AI_ROWS})")
def ai_sentence_score(m):
    rows = docs_of(m).select(
        F.col("id").alias("doc_id"), F.posexplode(ai.sentence_results(F.col("content"))).alias("pos", "r")
    )
    return rows.select(
        "doc_id", F.col("pos").cast("long").alias("pos"), F.col("r.text").alias("sentence"),
        F.col("r.ai_probability").alias("score"), F.col("r.is_likely_ai").alias("is_likely_ai"),
    )


AI_DOC = f"""SELECT d.doc_id, coalesce(a.mean, 0) * CASE WHEN length(d.text) < 200 THEN 0.8::double ELSE 1.0::double END AS p,
    coalesce(a.n, 0) AS n_sentences FROM documents d LEFT JOIN (
    SELECT doc_id, sum(score) / count(*) AS mean, count(*) AS n FROM ({AI_ROWS}) GROUP BY doc_id) a ON a.doc_id = d.doc_id"""
AI_OUT = f"""SELECT doc_id, round_even(p * 100, 0) / 100 AS ai_probability,
    CASE WHEN p > 70 THEN 'High' WHEN p > 40 THEN 'Medium' ELSE 'Low' END AS detection_level,
    CASE WHEN p > 75 THEN {quoted(fixed.AI_SUMMARY_HIGH)} WHEN p > 50 THEN {quoted(fixed.AI_SUMMARY_MEDIUM)}
    ELSE {quoted(fixed.AI_SUMMARY_LOW)} END AS summary, n_sentences FROM ({AI_DOC})"""


@query("A6_ai_document_score", AI_OUT)
def ai_document_score(m):
    scored = ai_plan.score_ai(docs_of(m))
    return scored.select(
        "doc_id", "ai_probability", "detection_level", "summary", F.size("sentences").cast("long").alias("n_sentences")
    )


@query("S5_ai_json_roundtrip", f"SELECT doc_id, ai_probability, detection_level, n_sentences FROM ({AI_OUT})")
def ai_json_roundtrip(m):
    stored = ai_plan.score_ai(docs_of(m)).select(
        "doc_id", ai.to_stored(F.lit("2024-05-01 10:00:00").cast("timestamp_ntz")).alias("stored")
    )
    back = stored.select("doc_id", ai.from_stored(F.col("stored")).alias("r"))
    return back.select(
        "doc_id", "r.ai_probability", "r.detection_level", F.size("r.sentences").cast("long").alias("n_sentences")
    )


@query("X20_title_from_path", "SELECT page_id, translate(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^/.]*$', ''), '_-', '  ') AS title FROM pages")
def title_from_path(m):
    return m.raw("pages").select("page_id", text.title_from_path(F.col("url")).alias("title"))


@query("X21_round2", "SELECT event_id, round_even(value * 1.5::double * 100, 0) / 100 AS rounded FROM events")
def round2(m):
    return m.raw("events").select("event_id", text.round2(F.col("value") * 1.5).alias("rounded"))


@query("X22_word_count_ws", f"SELECT doc_id AS id, len(list_filter(string_split_regex(text, '{WS}+'), lambda x: x <> '')) AS n FROM documents")
def word_count_ws(m):
    return docs_of(m).select("id", text.word_count_ws(F.col("content")).cast("long").alias("n"))


@query(
    "W3_sentence_offsets",
    f"""SELECT doc_id, pos, CAST(coalesce(sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start_position
    FROM (SELECT doc_id, i - 1 AS pos, sents[i] AS s FROM (SELECT doc_id, sents, unnest(range(1, len(sents) + 1)) AS i
    FROM (SELECT doc_id, {PLAIN} AS sents FROM documents)))""",
)
def sentence_offsets(m):
    rows = sentence_plan.sentence_offsets(sentence_plan.plain_sentences(docs_of(m)))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "start_position")


def pairs_sql(n: int) -> str:
    parts = " || ' ' || ".join(f"t[i + {k}]" for k in range(n))
    toks = f"list_filter(string_split({norm('text')}, ' '), lambda x: x <> '')"
    gs = f"CASE WHEN len(t) >= {n} THEN list_distinct(list_transform(range(1, len(t) - {n} + 2), lambda i: {parts})) ELSE [] END"
    return f"""SELECT conv_id, turn, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE
      len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) * 100 END AS score FROM (
      SELECT p.conv_id, p.turn, p.g AS a, q.g AS b FROM g p JOIN g q ON q.conv_id = p.conv_id AND q.turn = p.turn + 1)""", {
        "g": f"SELECT conv_id, turn, {gs} AS g FROM (SELECT conv_id, turn, {toks} AS t FROM conversations)"
    }


U1_BODY, U1_STEPS = pairs_sql(3)


@query("U1_array_jaccard", with_tables("", U1_BODY, **U1_STEPS))
def array_jaccard(m):
    """Overlap of each turn with the next one of its conversation."""
    grams = m.raw("conversations").select("conv_id", "turn", text.ngrams(F.col("text"), 3).alias("g"))
    following = grams.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("g").alias("h"))
    return grams.join(following, ["conv_id", "turn"]).select(
        "conv_id", "turn", text.jaccard(F.col("g"), F.col("h")).alias("score")
    )
