"""Text corpus, retrieval, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.lineage import cut_lineage
from ...operators import answers, text
from ..registry import load, query, rounded, rounded_sql
from .q01_sources import scratch
from .q05_graphs import DAG, flows

STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _docs(spark, sf):
    return load(spark, sf, "documents")


@query(
    "chunk_paragraphs",
    f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
    k AS (SELECT doc_id, i::INT AS chunk_id, {STRIP.format('c')} AS content FROM p) SELECT * FROM k WHERE content <> ''
    UNION ALL SELECT doc_id, 0, '[Empty file]' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE content <> '')""",
)
def chunk_paragraphs(spark, sf):
    return text.chunk_paragraphs(_docs(spark, sf), "text", ["doc_id"], "\n")


@query("chunk_recursive")
def chunk_recursive(spark, sf):
    return text.chunk_recursive(_docs(spark, sf), "text", ["doc_id"])


@query(
    "chunk_stride",
    """WITH s AS (SELECT doc_id, text, unnest(range(0, greatest(ceil((length(text) - 200) / 800.0)::BIGINT - 1, 0) + 1)) AS i FROM documents WHERE length(text) > 0)
    SELECT doc_id, i::INT AS chunk_id, substring(text, i * 800 + 1, 1000) AS content FROM s""",
)
def chunk_stride(spark, sf):
    return text.chunk_stride(_docs(spark, sf), "text", ["doc_id"])


def _title_sql(col: str) -> str:
    first = f"coalesce(list_filter(list_transform(string_split({col}, chr(10)), lambda x: {STRIP.format('x')}), lambda x: x <> '')[1], '')"
    starts = " OR ".join(f"starts_with(lower(f), '{s}')" for s in ["#", "<", "<!--", "/*", "```", "title:", "author:", "date:"])
    return f"SELECT CASE WHEN length(f) > 5 AND length(f) < 200 AND NOT ({starts}) AND NOT contains(lower(f), 'http') AND NOT contains(lower(f), 'www') THEN f ELSE '' END FROM (SELECT {first} AS f)"


@query("extract_title", f"SELECT doc_id, ({_title_sql('text')}) AS title FROM documents")
def extract_title(spark, sf):
    return _docs(spark, sf).select("doc_id", text.extract_title(F.col("text")).alias("title"))


@query(
    "sanitize_metadata",
    """SELECT doc_id, lang, source, n_chars::VARCHAR AS n_chars, CASE WHEN quality IS NULL THEN NULL ELSE quality::VARCHAR END AS quality, lang || ', ' || source AS tags
    FROM documents LEFT JOIN labels USING (doc_id)""",
)
def sanitize_metadata(spark, sf):
    df = _docs(spark, sf).join(load(spark, sf, "labels"), "doc_id", "left").withColumn("tags", F.array("lang", "source"))
    out = text.sanitize_metadata(df, ["lang", "source", "n_chars", "quality", "tags"])
    return out.select("doc_id", *[F.try_element_at("metadata", F.lit(c)).alias(c) for c in ("lang", "source", "n_chars", "quality", "tags")])


def _chunk_table(spark, sf):
    """Paragraph chunks of all documents, named by source, with metadata."""
    df = text.sanitize_metadata(_docs(spark, sf).withColumn("title", text.extract_title(F.col("text"))), ["lang", "source", "title"])
    return text.chunk_paragraphs(df.withColumnRenamed("doc_id", "document_id"), "text", ["document_id", "metadata"], "\n")


CHUNKS = f"""ck AS (WITH p AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS c, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
k AS (SELECT doc_id, lang, source, i::INT AS chunk_id, {STRIP.format('c')} AS content FROM p) SELECT * FROM k WHERE content <> ''
UNION ALL SELECT doc_id, lang, source, 0, '[Empty file]' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM k WHERE content <> ''))"""


@query(
    "ingest_new",
    f"""WITH {CHUNKS} SELECT doc_id::VARCHAR AS document_id, CASE WHEN lang = 'en' THEN 'first' ELSE 'second' END AS run, chunk_id, md5(content) AS content FROM ck""",
)
def ingest_new(spark, sf):
    """Every document is a file; the English ones are there at the first run, the others come before the second, and the third finds nothing new."""
    root = scratch(spark, "corpus")
    store, progress = scratch(spark, "chunks"), scratch(spark, "progress")
    docs, english = _docs(spark, sf).select("doc_id", "text", "lang"), F.coalesce(F.col("lang") == "en", F.lit(False))
    for run, part in (("first", docs.where(english)), ("second", docs.where(~english)), ("third", None)):
        if part is not None:
            text.write_files(part, "doc_id", "text", f"{root}/{run}")
        chunks = text.ingest_stream(spark, root, store, progress, run, "*.txt", "\n", r"doc_id=([^/]+?)(?:/|\.txt$)")
    return chunks.select("document_id", "run", "chunk_id", F.md5(F.col("content").cast("binary")).alias("content"))


@query("list_documents", f"WITH {CHUNKS} SELECT doc_id AS document_id, count(*) AS chunks, sum(length(content))::BIGINT AS characters, any_value(lang) AS lang FROM ck GROUP BY 1")
def list_documents(spark, sf):
    return text.list_documents(_chunk_table(spark, sf)).select("document_id", "chunks", "characters", F.col("metadata")["lang"].alias("lang"))


@query(
    "get_delete_chunks",
    f"""WITH {CHUNKS}, bad AS (SELECT doc_id FROM labels WHERE toxic = 1) SELECT 'got' AS part, lang, count(*) AS chunks FROM ck WHERE doc_id IN (FROM bad) GROUP BY 2
    UNION ALL SELECT 'left', lang, count(*) FROM ck WHERE doc_id NOT IN (FROM bad) GROUP BY 2""",
)
def get_delete_chunks(spark, sf):
    chunks = _chunk_table(spark, sf)
    bad = load(spark, sf, "labels").where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    both = text.get_chunks(chunks, bad).withColumn("part", F.lit("got")).unionByName(text.delete_chunks(chunks, bad).withColumn("part", F.lit("left")))
    return both.groupBy("part", F.col("metadata")["lang"].alias("lang")).agg(F.count(F.lit(1)).alias("chunks"))


@query("embed_text")
def embed_text(spark, sf):
    out = text.embed_text(_docs(spark, sf).select("doc_id", "text"), "text", 256)
    return out.select("doc_id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm2"))


def _queries(spark, sf):
    """One question per embedding label: the unit vector of its mean, worded by a benchmark passage."""
    long = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    mean = long.groupBy("label", "i").agg(F.avg("v").alias("v")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("c"))
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda a, x: a + x["v"] * x["v"]))
    vec = mean.select(F.col("label").alias("query_id"), F.transform("c", lambda x: x["v"] / norm).alias("embedding"))
    words = load(spark, sf, "benchmark").select(F.col("item_id").cast("int").alias("query_id"), "text")
    return cut_lineage(vec.join(words, "query_id"))


def _vectors(spark, sf):
    """Documents that have a vector, as one chunk each."""
    df = text.sanitize_metadata(_docs(spark, sf).withColumn("title", text.extract_title(F.col("text"))), ["lang", "source", "title"])
    vec = load(spark, sf, "embeddings").select(F.col("vec_id").alias("document_id"), "embedding")
    return df.select(F.col("doc_id").alias("document_id"), F.lit(0).alias("chunk_id"), F.col("text").alias("content"), "metadata").join(vec, "document_id")


FOUND = """qv AS (SELECT label AS query_id, i, avg(v) AS v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
q AS (SELECT query_id, list_transform(list(v ORDER BY i), lambda x: x / sqrt(sum(v * v))) AS e, any_value(text) AS text FROM qv JOIN benchmark ON item_id = query_id GROUP BY 1),
dist AS (SELECT query_id, vec_id AS document_id, list_sum(list_transform(list_zip(e, embedding), lambda z: power(z[1] - z[2]::DOUBLE, 2))) AS distance FROM q, embeddings JOIN documents ON doc_id = vec_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, document_id)::INT AS rank FROM dist),
found AS (SELECT query_id, document_id, distance, CASE WHEN distance <= 1 THEN 1 - distance ELSE 1 / distance END AS score, rank FROM rk WHERE rank <= 5 AND CASE WHEN distance <= 1 THEN 1 - distance ELSE 1 / distance END >= 0.2),
full_ AS (SELECT f.*, d.text AS content, lang, source, q.text AS query FROM found f JOIN documents d ON doc_id = document_id JOIN q USING (query_id))"""


@query("vector_topk", rounded_sql(f"WITH {FOUND} SELECT query_id, document_id, rank, distance, score FROM found", "query_id document_id rank", "distance score"))
def vector_topk(spark, sf):
    return rounded(text.vector_topk(_queries(spark, sf), _vectors(spark, sf)).drop("chunk_id"))


@query("metadata_search", f"WITH {CHUNKS} SELECT doc_id AS document_id, chunk_id, content FROM ck WHERE lang = 'fr' AND source = 'src1' ORDER BY doc_id, chunk_id LIMIT 10")
def metadata_search(spark, sf):
    return text.metadata_search(_chunk_table(spark, sf), {"lang": "fr", "source": "src1"}, 10).select("document_id", "chunk_id", "content")


def _retrieved(spark, sf):
    q, v = _queries(spark, sf), cut_lineage(_vectors(spark, sf))
    return text.with_content(text.vector_topk(q, v), v, q)


HIT = r"len(list_filter(list_filter(string_split_regex(lower(query), '[^\p{L}\p{N}_]+'), lambda w: w <> ''), lambda w: contains(lower(content) || chr(10) || lower(lang) || chr(10) || lower(source) || chr(10) || lower(title), w))) > 0"
TITLED = f"titled AS (SELECT *, ({_title_sql('content')}) AS title FROM full_)"


@query("keyword_filter", f"WITH {FOUND}, {TITLED} SELECT query_id, document_id, rank FROM titled WHERE {HIT}")
def keyword_filter(spark, sf):
    return text.keyword_filter(_retrieved(spark, sf)).select("query_id", "document_id", "rank")


@query(
    "hybrid_search",
    rounded_sql(f"""WITH {FOUND}, {TITLED}, h AS (SELECT query_id, document_id, score * 0.7 + ({HIT})::INT * 0.3 AS hybrid FROM titled)
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hybrid DESC, document_id)::INT AS hybrid_rank FROM h QUALIFY hybrid_rank <= 3""", "query_id document_id hybrid_rank", "hybrid"),
)
def hybrid_search(spark, sf):
    return rounded(text.hybrid_search(_retrieved(spark, sf), 3).select("query_id", "document_id", "hybrid_rank", "hybrid"))


PACK = f"""{TITLED}, doc AS (SELECT *, 'Document: ' || title || ' (Unknown Author)' || chr(10) || chr(10) || content AS body FROM titled),
tok AS (SELECT *, length(body) // 4 AS tk, sum(length(body) // 4) OVER (PARTITION BY query_id ORDER BY score DESC, document_id) AS run FROM doc),
pack AS (SELECT query_id, count(*) AS documents, sum(tk)::BIGINT AS tokens, string_agg(body, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, document_id) AS context FROM tok WHERE run <= 4000 GROUP BY 1)"""


@query("context_pack", f"WITH {FOUND}, {PACK} SELECT * FROM pack")
def context_pack(spark, sf):
    return text.context_pack(_retrieved(spark, sf), 4000)


@query(
    "augment_prompts",
    f"""WITH {FOUND}, {PACK} SELECT item_id AS query_id, text AS prompt, context IS NOT NULL AS context_used, CASE WHEN context IS NULL THEN 'Be brief.' ELSE
    concat_ws(chr(10) || chr(10), 'Be brief.', '{text.CONTEXT_INTRO}', context, '{text.CONTEXT_OUTRO}') END AS system_prompt FROM benchmark LEFT JOIN pack ON query_id = item_id""",
)
def augment_prompts(spark, sf):
    prompts = load(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("prompt"), F.lit("Be brief.").alias("system_prompt"))
    packs = text.context_pack(_retrieved(spark, sf), 4000).withColumn("query_id", F.col("query_id").cast("long"))
    return text.augment_prompts(prompts, packs)


# answers in the expected wording, made from the trade edges and their numbers
ANSWER = """ans AS (SELECT graph_id, src, dst, CASE WHEN time_lag = 3 THEN 'I cannot tell.' ELSE 'Analysis of ' || src || chr(10) || '  Valid: ' || CASE WHEN is_hidden_cause THEN 'No' ELSE 'Yes, likely' END || chr(10) || 'Confidence: ' ||
CASE WHEN confidence IS NULL THEN 'high' ELSE floor(confidence * 10)::INT::VARCHAR END || chr(10) || 'Reverse direction suggested: ' || CASE WHEN bidirected THEN 'Yes' ELSE 'No' END || chr(10) || 'Reasoning: because of ' || dst || chr(10) || 'and more ' END AS answer FROM flows)"""
VERDICT = ANSWER + r""", verdict AS (SELECT *, coalesce(contains(lower(regexp_extract(answer, '(?m)^\s*Valid:([^:\n]*)', 1)), 'yes'), false) AS is_valid,
coalesce(try_cast(trim(regexp_extract(answer, '(?m)^\s*Confidence:([^:\n]*)', 1)) AS DOUBLE) / 10, 0.5) AS confidence, contains(lower(regexp_extract(answer, '(?m)^\s*Reverse direction suggested:([^:\n]*)', 1)), 'yes') AS reverse_suggested,
CASE WHEN contains(answer, 'Reasoning:') THEN regexp_replace(answer[position('Reasoning:' IN answer) + 10:], '^\s+|\s+$', '', 'g') ELSE '' END AS reasoning FROM ans)"""


def _answers(e):
    parts = [
        F.lit("Analysis of "), F.col("src"), F.lit("\n  Valid: "), F.when(F.col("is_hidden_cause"), "No").otherwise("Yes, likely"), F.lit("\nConfidence: "),
        F.coalesce(F.floor(F.col("confidence") * 10).cast("int").cast("string"), F.lit("high")), F.lit("\nReverse direction suggested: "),
        F.when(F.col("bidirected"), "Yes").otherwise("No"), F.lit("\nReasoning: because of "), F.col("dst"), F.lit("\nand more "),
    ]
    return e.select("graph_id", "src", "dst", F.when(F.col("time_lag") == 3, "I cannot tell.").otherwise(F.concat(*parts)).alias("answer"))


@query(
    "edge_prompts",
    f"""WITH {DAG} SELECT graph_id, src, dst, 'Does ' || src || ' directly cause ' || dst || '?' || chr(10) || chr(10) || 'Edges: ' || (SELECT count(*) FROM flows) || chr(10) || chr(10) || 'Trade data' || chr(10) || chr(10)
    || 'Weigh mechanism, time order, the statistics, common causes and the opposite direction. Answer in four lines:' || chr(10) || 'Valid: Yes or No' || chr(10) || 'Confidence: 1 to 10' || chr(10) || 'Reverse direction suggested: Yes or No' || chr(10) || 'Reasoning: your steps' AS prompt FROM flows""",
)
def edge_prompts(spark, sf):
    e = flows(spark, sf)
    return answers.edge_prompts(e, f"Edges: {e.count()}", "Trade data")


@query("parse_edge_verdicts", rounded_sql(f"WITH {DAG}, {VERDICT} SELECT graph_id, src, dst, is_valid, confidence, reverse_suggested, reasoning FROM verdict", "graph_id src dst is_valid reverse_suggested reasoning", "confidence"))
def parse_edge_verdicts(spark, sf):
    return rounded(answers.parse_edge_verdicts(_answers(flows(spark, sf))).drop("answer"))


@query(
    "apply_verdicts",
    rounded_sql(f"""WITH {DAG}, {VERDICT}, v AS (SELECT * FROM verdict WHERE answer <> 'I cannot tell.'), j AS (SELECT f.graph_id, f.src, f.dst, v.is_valid, v.confidence, v.reverse_suggested FROM flows f LEFT JOIN v ON v.graph_id = f.graph_id AND v.src = f.src AND v.dst = f.dst),
    k AS (SELECT graph_id, src, dst, coalesce(confidence, 0.5) AS confidence, false AS reversed FROM j WHERE is_valid IS NULL OR (is_valid AND confidence >= 0.5))
    SELECT * FROM k UNION ALL SELECT graph_id, dst, src, confidence, true FROM j WHERE NOT is_valid AND reverse_suggested AND NOT EXISTS (FROM k WHERE k.graph_id = j.graph_id AND k.src = j.dst AND k.dst = j.src)""", "graph_id src dst reversed", "confidence"),
)
def apply_verdicts(spark, sf):
    e = flows(spark, sf)
    verdicts = answers.parse_edge_verdicts(_answers(e)).where("answer <> 'I cannot tell.'")
    return rounded(answers.apply_verdicts(e, verdicts))


# one JSON answer per month: odd places by number, the others by name in either order
@query(
    "apply_directions",
    f"""WITH {DAG}, n AS (SELECT graph_id, src, dst, time_lag, CASE WHEN bidirected THEN 'bidirected' WHEN is_hidden_cause THEN 'backward' ELSE 'forward' END AS d FROM flows WHERE time_lag < 3)
    SELECT graph_id, CASE WHEN d = 'backward' THEN dst ELSE src END AS src, CASE WHEN d = 'backward' THEN src ELSE dst END AS dst, d = 'bidirected' AS bidirected FROM n
    UNION ALL SELECT graph_id, dst, src, true FROM n WHERE d = 'bidirected'""",
)
def apply_directions(spark, sf):
    e = flows(spark, sf)
    way = F.when(F.col("bidirected"), "bidirected").when(F.col("is_hidden_cause"), "backward").otherwise("forward")
    from pyspark.sql import Window

    no = F.row_number().over(Window.partitionBy("graph_id").orderBy("src", "dst"))
    key = F.when(F.col("time_lag") == 0, F.concat(F.lit("edge"), F.col("no"))).when(F.col("time_lag") == 1, F.concat("src", F.lit("--"), "dst")).when(F.col("time_lag") == 2, F.concat("dst", F.lit("--"), "src"))
    said = e.withColumn("no", no).select("graph_id", key.alias("k"), way.alias("v")).where("k IS NOT NULL")
    packed = said.groupBy("graph_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    ans = packed.select("graph_id", F.concat(F.lit("Sure:\n```json\n"), F.to_json("m"), F.lit("\n```\nDone.")).alias("answer"))
    return answers.apply_directions(e, ans)


@query(
    "parse_hidden_variables",
    rounded_sql("""SELECT c_nationkey AS graph_id, k AS number, CASE WHEN k = 1 THEN 'Wealth' ELSE 'Region: ' || c_nationkey END AS name, 'mean ' || round(avg(c_acctbal))::BIGINT AS description, CASE WHEN k = 1 THEN ['balance', 'orders'] ELSE ['orders'] END AS children,
    CASE WHEN k = 1 THEN 0.8::DOUBLE ELSE 0.5 END AS confidence FROM customer, (SELECT unnest([1, 2])::INT AS k) GROUP BY 1, 2""", "graph_id number name description children", "confidence"),
)
def parse_hidden_variables(spark, sf):
    mean = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("graph_id")).agg(F.round(F.avg("c_acctbal")).cast("long").alias("m"))
    ans = F.concat(
        F.lit("Some thoughts.\nHidden Variable 1:\nName: Wealth\nDescription: mean "), F.col("m"), F.lit("\nAffects: balance, orders\nConfidence: 8\n\nHidden Variable 2:\nName: Region: "),
        F.col("graph_id"), F.lit("\nDescription: mean "), F.col("m"), F.lit("\nAffects: orders\nConfidence: sure\nHidden Variable 3:\nDescription: no name\n"),
    )
    return rounded(answers.parse_hidden_variables(mean.select("graph_id", ans.alias("answer")), ["graph_id"]))


@query(
    "parse_json_answers",
    """WITH n AS (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1)
    SELECT id, 'primary' AS list, 0 AS position, 'pc' AS item FROM n UNION ALL SELECT id, 'primary', 1, 'ges ' || n FROM n UNION ALL SELECT id, 'secondary', 0, 'anm' FROM n UNION ALL SELECT id, 'not_recommended', 0, 'size ' || n FROM n WHERE id >= 8""",
)
def parse_json_answers(spark, sf):
    n = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    full = F.format_string('{"primary": ["pc", "ges %d"], "secondary": ["anm"], "not_recommended": ["size %d"]}', F.col("n"), F.col("n"))
    half = F.format_string('Here:\n```json\n{"primary": ["pc", "ges %d"], "secondary": ["anm"]}\n```', F.col("n"))
    free = F.format_string("My view.\nPrimary\n- pc\n- ges %d\n\nSecondary:\n1. anm\nNot recommended\n* size %d", F.col("n"), F.col("n"))
    ans = F.when(F.col("id") < 8, half).when(F.col("id") < 16, full).otherwise(free)
    return answers.parse_json_answers(n.select("id", ans.alias("answer")), ["id"])


KNOWN = "n AS (SELECT c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1)"


@query(
    "parse_knowledge_answers",
    f"""WITH {KNOWN}, e AS (
    SELECT id, 'variables' AS part, 0 AS position, 'age group' AS name, NULL AS source, NULL AS target, 'categorical' AS type, NULL AS description, NULL::DOUBLE AS confidence, ['young', 'old ' || n] AS possible_values FROM n WHERE id < 16
    UNION ALL SELECT id, 'variables', 1, 'income', NULL, NULL, 'continuous', 'mean of ' || n, NULL, NULL FROM n WHERE id < 16
    UNION ALL SELECT id, 'relationships', 0, NULL, 'age group', 'income', 'direct', 'n=' || n, CASE WHEN id < 8 THEN 0.9::DOUBLE END, NULL FROM n WHERE id < 16
    UNION ALL SELECT id, 'constraints', 0, NULL, 'income', 'age group', 'forbidden_edge', NULL, NULL, NULL FROM n WHERE id < 8
    UNION ALL SELECT id, 'background', 0, NULL, NULL, NULL, NULL, n || ' customers', NULL, NULL FROM n WHERE id < 8) FROM e""",
)
def parse_knowledge_answers(spark, sf):
    n = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    variables = '"variables": {"income": {"description": "mean of %d", "type": "continuous"}, "age group": {"type": "categorical", "possible_values": ["young", "old %d"]}}'
    full = F.format_string(
        "As asked:\n```json\n{" + variables + ', "relationships": [{"source": "age group", "target": "income", "confidence": 0.9, "type": "direct", "description": "n=%d"}, "oops"], '
        '"constraints": [{"type": "forbidden_edge", "source": "income", "target": "age group"}], "background": "%d customers"}\n```', *["n"] * 4,
    )
    half = F.format_string("{" + variables + ', "relationships": [{"source": "age group", "target": "income", "confidence": "sure", "type": "direct", "description": "n=%d"}], "constraints": {}}', *["n"] * 3)
    ans = F.when(F.col("id") < 8, full).when(F.col("id") < 16, half).otherwise("I know nothing of {this}.")
    return answers.parse_knowledge_answers(n.select("id", ans.alias("answer")), ["id"])


@query(
    "parse_conflict_answers",
    f"WITH {KNOWN} SELECT id, ['forward', 'backward', 'bidirected'][id % 3 + 1] AS direction, (n % 10 + 1)::INT AS confidence FROM n WHERE id < 20",
)
def parse_conflict_answers(spark, sf):
    n = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    good = F.concat(F.lit("Let me think.\n  Direction: "), F.col("id") % 3 + 1, F.lit("\nConfidence: "), F.col("n") % 10 + 1, F.lit("\nReasoning: as above\nDirection: 9"))
    ans = F.when(F.col("id") < 20, good).when(F.col("id") < 22, "Direction: 1\nno confidence").when(F.col("id") < 24, "Direction: both\nConfidence: 3")
    return answers.parse_conflict_answers(n.select("id", ans.alias("answer")), ["id"])
