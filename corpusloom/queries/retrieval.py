"""Retrieval queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vectors as V
from ..operators import retrieval as R
from ..plans import builder, runner
from ..registry import query, table

CHUNKS = r"""chunks AS (SELECT doc_id, pos, doc_id || '_sent_' || pos AS id, text FROM (
  SELECT doc_id, unnest(range(0, len(p))) AS pos, regexp_replace(unnest(p), '^\s+|\s+$', '', 'g') AS text FROM (SELECT doc_id, string_split(text, '.') AS p FROM documents)) WHERE text <> '')"""
HASH = """((list_reduce(list_prepend(0::BIGINT, list_transform(regexp_extract_all(text, '(?s).'), lambda c: unicode(c)::BIGINT)), lambda a, c: (a * 31 + c) % 4294967296)))"""
EMBED = f"""emb AS (SELECT *, list_transform(range(1, 9), lambda i: ((CASE WHEN (h * i) % 4294967296 >= 2147483648 THEN (h * i) % 4294967296 - 4294967296 ELSE (h * i) % 4294967296 END) % 1000) / 1000.0::DOUBLE) AS v
  FROM (SELECT *, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM (SELECT *, {HASH} AS h FROM chunks) AS raw(doc_id, pos, id, text, h)))"""
COS = "coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0)"
FIRST = "(SELECT v FROM emb ORDER BY doc_id, pos LIMIT 1)"


@query(f"WITH {CHUNKS} SELECT doc_id, pos, id, text FROM chunks")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.chunk(table(spark, sf_dir, "documents"))


@query(f"WITH {CHUNKS} SELECT doc_id, pos, text FROM chunks WHERE length(text) >= 3")
def filter_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.filter_refs(R.chunk(table(spark, sf_dir, "documents")), [R.long_enough()]).select("doc_id", "pos", "text")


@query(f"WITH {CHUNKS} SELECT doc_id, pos, length(text) AS n FROM chunks WHERE length(text) >= 3 AND length(text) BETWEEN 40 AND 300 AND doc_id IN (SELECT doc_id FROM documents WHERE lang IN ('fr', 'de'))")
def filter_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("lang").isin("fr", "de"))
    return R.filter_refs(R.chunk(docs), [R.long_enough(), F.length("text").between(40, 300)]).select("doc_id", "pos", F.length("text").alias("n"))


@query("SELECT doc_id, text FROM documents WHERE source = 'src1' AND text <> '' AND lang = 'en'")
def sentence_loader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of one key with content, in order."""
    return table(spark, sf_dir, "documents").where("source = 'src1' AND text > '' AND lang = 'en'").select("doc_id", "text").orderBy("doc_id")


@query(f"WITH {CHUNKS}, {EMBED} SELECT doc_id, pos, round(v[1], 6) AS e0, round(v[2], 6) AS e1, round(v[8], 6) AS e7 FROM emb")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = R.chunk(table(spark, sf_dir, "documents")).select("doc_id", "pos", V.hash_embedding(F.col("text")).alias("v"))
    return chunks.select("doc_id", "pos", *[F.round(F.col("v")[i], 6).alias(f"e{i}") for i in (0, 1, 7)])


@query(
    "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) "
    f"SELECT vec_id, round({COS.format(a='embedding::DOUBLE[]', b='q')}, 6) AS score FROM embeddings, q ORDER BY {COS.format(a='embedding::DOUBLE[]', b='q')} DESC, vec_id LIMIT 10"
)
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").first()
    return R.top_k(vectors, list(first.embedding) if first else [], 10, "vec_id", "embedding").withColumn("score", F.round("score", 6))


@query(
    "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0) "
    f"SELECT vec_id, round({COS.format(a='embedding::DOUBLE[]', b='q')}, 6) AS score FROM embeddings, q WHERE label = 3 ORDER BY {COS.format(a='embedding::DOUBLE[]', b='q')} DESC, vec_id LIMIT 10"
)
def vector_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    first = vectors.where("vec_id = 0").first()
    return R.top_k(vectors, list(first.embedding) if first else [], 10, "vec_id", "embedding", R.metadata_filter({"label": 3})).withColumn("score", F.round("score", 6))


@query(
    "WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round("
    + COS.format(a="a.embedding::DOUBLE[]", b="b.embedding::DOUBLE[]")
    + ", 9) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, vec_id, rank FROM r WHERE rank <= 5"
)
def vector_topk_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries are the rows with ids divisible by 20, searched for among all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return R.top_k_batched(queries, vectors, 5, "query_id", "vec_id", "embedding").select("query_id", "vec_id", "rank")


@query("SELECT label, pos - 1 AS pos, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding::DOUBLE[]) AS x, unnest(range(1, 65)) AS pos FROM embeddings) GROUP BY label, pos")
def vector_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.mean_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding").select("label", "pos", F.round("mean", 6).alias("mean"))


@query("SELECT vec_id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(V.unit(e)[0], 6).alias("first"))


@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(a.e[i] - b.e[i], 2)))), 6) AS gap, round(a.e[1] + b.e[1], 6) AS sum0 FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) a JOIN (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) b ON b.vec_id = a.vec_id + 1")
def vector_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("x"))
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.norm(V.subtract(F.col("x"), F.col("y"))), 6).alias("gap"), F.round(V.add(F.col("x"), F.col("y"))[0], 6).alias("sum0"))


LOGITS = "embedding::DOUBLE[]"


@query(
    f"""WITH l AS (SELECT vec_id, {LOGITS} AS v FROM embeddings), e AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM l)
    SELECT vec_id, round(e[1] / list_sum(e), 6) AS p0, list_position(v, list_max(v)) - 1 AS best, round(list_max(e) / list_sum(e), 6) AS p_best,
      round(list_max(v) + ln(list_sum(e)), 6) AS lse, round(1 / (1 + exp(-v[2])), 6) AS gate FROM e"""
)
def softmax_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax, argmax, log-sum-exp and sigmoid of rows of logits."""
    v = V.doubles(F.col("embedding"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("p", V.softmax(F.col("v")))
    return rows.select("vec_id", F.round(F.col("p")[0], 6).alias("p0"), V.argmax(F.col("v")).alias("best"), F.round(F.array_max("p"), 6).alias("p_best"), F.round(V.log_sum_exp(F.col("v")), 6).alias("lse"), F.round(V.sigmoid(F.col("v")[1]), 6).alias("gate"))


@query(
    f"""WITH l AS (SELECT vec_id, label, {LOGITS} AS v FROM embeddings), m AS (SELECT vec_id, label, list_transform(range(1, len(v) + 1), lambda i: CASE WHEN (i - 1) % 3 = label % 3 THEN v[i] ELSE v[i] - 1e9 END) AS v FROM l),
    e AS (SELECT vec_id, v, list_transform(v, lambda x: exp(x - list_max(v))) AS e FROM m) SELECT vec_id, list_position(v, list_max(v)) - 1 AS best, round(list_max(e) / list_sum(e), 6) AS p_best FROM e"""
)
def masked_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax inside the family of labels that the row's coarse label allows."""
    mask = F.transform("embedding", lambda _, i: i % 3 == F.col("label") % 3)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", V.doubles(F.col("embedding")).alias("v"), mask.alias("m"))
    p = V.masked_softmax(F.col("v"), F.col("m"))
    return rows.select("vec_id", p.alias("p")).select("vec_id", V.argmax(F.col("p")).alias("best"), F.round(F.array_max("p"), 6).alias("p_best"))


@query(
    f"""WITH l AS (SELECT vec_id, {LOGITS} AS v FROM embeddings), e AS (SELECT vec_id, list_transform(v, lambda x: exp(16 * (x - list_max(v)))) AS e FROM l),
    p AS (SELECT vec_id, unnest(range(0, len(e))) AS label, unnest(list_transform(e, lambda x: x / list_sum(e))) AS p FROM e), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY p DESC, label) AS k FROM p)
    SELECT vec_id, label, k, round(p, 6) AS p FROM r WHERE k <= 5 AND p > 0.1"""
)
def class_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most five labels of a row, each over a floor."""
    p = V.softmax(V.doubles(F.transform("embedding", lambda x: x * 16)))
    pairs = F.transform(p, lambda x, i: F.struct((-x).alias("minus"), i.alias("label"), x.alias("p")))
    best = F.slice(F.array_sort(pairs), 1, 5)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(best).alias("k", "b"))
    return rows.where("b.p > 0.1").select("vec_id", "b.label", (F.col("k") + 1).alias("k"), F.round("b.p", 6).alias("p"))


@query(
    f"WITH {CHUNKS}, {EMBED}, s AS (SELECT id, doc_id, pos, {COS.format(a='v', b=FIRST)} AS score FROM emb), top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM s) SELECT rank, id, round(score, 6) AS score FROM top WHERE rank <= 5"
)
def rag_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk, embed, and search with the first chunk's vector."""
    return runner.search(table(spark, sf_dir, "documents"), 5).select("rank", "id", F.round("score", 6).alias("score"))


@query(
    f"""WITH {CHUNKS}, {EMBED}, s AS (SELECT id, doc_id, pos, text, {COS.format(a='v', b=FIRST)} AS score FROM emb WHERE length(text) >= 3), top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM s),
    best AS (SELECT text FROM top WHERE rank <= 5 ORDER BY length(text) DESC, rank LIMIT 1) SELECT 'Q: what is this about? A: ' || coalesce((SELECT text FROM best), '(no context)') AS answer"""
)
def rag_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan: raw, chunk, filter, embed, retrieve, hydrate, rerank, answer."""
    plan = builder.rag().from_raw().chunk().filter("length>=3").embed().retrieve(5).hydrate().rerank(3).generate("what is this about?").compile()
    return runner.run(plan, table(spark, sf_dir, "documents"))


@query(
    f"""WITH {CHUNKS}, {EMBED}, s AS (SELECT id, doc_id, pos, text, {COS.format(a='v', b=FIRST)} AS score FROM emb), top AS (SELECT *, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id, pos) AS rank FROM s)
    SELECT id, text FROM top WHERE rank <= 40"""
)
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches that differ in k, merged by id: the union is the larger branch."""
    docs = table(spark, sf_dir, "documents")
    left, right = (runner.search(docs, k).select("id", F.col("rank").alias("pos"), "text") for k in (10, 40))
    return R.merge(left, right, "id").select("id", "text")


@query("WITH w AS (SELECT doc_id, row_number() OVER (ORDER BY md5('7' || doc_id)) AS pos FROM documents), i AS (SELECT pos, doc_id FROM w WHERE pos <= 50) SELECT pos, doc_id, n_chars FROM i JOIN documents USING (doc_id)")
def hydrate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    picked = docs.select("doc_id", F.md5(F.concat(F.lit("7"), F.col("doc_id").cast("string"))).alias("h")).orderBy("h").limit(50)
    ids = picked.withColumn("pos", F.row_number().over(Window.orderBy("h"))).select("pos", "doc_id")  # a list of fifty ids
    return R.hydrate(ids, docs.select("doc_id", "n_chars"), "doc_id", "pos").select("pos", "doc_id", "n_chars")


@query("SELECT doc_id, length(text)::DOUBLE AS score FROM documents ORDER BY length(text) DESC, doc_id LIMIT 10")
def rerank_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.rerank_by_length(table(spark, sf_dir, "documents"), 10, "doc_id").select("doc_id", "score")


@query("SELECT conv_id, parent AS unit_id, string_agg(text, chr(10) ORDER BY turn) AS text, count(*) AS n_elements FROM (SELECT conv_id, turn, turn // 2 AS parent, text FROM conversations) GROUP BY conv_id, parent")
def hydrate_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements grouped under their parent, texts joined in order."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("element_index"), F.col("turn").alias("element_id"), F.floor(F.col("turn") / 2).alias("parent_id"), "text")
    return R.hydrate_elements(turns, ["conv_id"])


@query("SELECT conv_id, 'Q: ' || text || ' A: ' || coalesce((SELECT b.text FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 LIMIT 1), '(no context)') AS answer FROM conversations a WHERE role = 'user'")
def answer_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    after = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("context"))
    asked = turns.where("role = 'user'").join(after, ["conv_id", "turn"], "left")
    return asked.select("conv_id", T.answer(F.col("text"), F.col("context")).alias("answer"))


@query("SELECT conv_id, '[' || string_agg(role || ': ' || left(text, 80), ' | ' ORDER BY turn) || ']' AS prompt FROM conversations GROUP BY conv_id")
def prompt_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prompt from a conversation's rows, in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit(": "), F.substring(t["text"], 1, 80)))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.concat(F.lit("["), F.array_join(lines, " | "), F.lit("]")).alias("prompt"))


_ELEMENTS = f"""{CHUNKS}, el AS (SELECT doc_id, pos AS i, CASE WHEN pos % 4 = 0 THEN NULL ELSE pos // 4 * 4 END AS parent, pos % 3 <> 2 AS s, text FROM chunks WHERE doc_id % 2 = 0)"""


@query(
    f"""WITH {_ELEMENTS} SELECT 'SENTENCE' AS unit, doc_id, i::VARCHAR AS unit_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos, text, 1::BIGINT AS n_elements FROM el WHERE s
    UNION ALL SELECT 'DOCUMENT', doc_id, 'document', min(i), string_agg(text, chr(10) ORDER BY i), count(*) FROM el GROUP BY doc_id UNION ALL SELECT 'PARAGRAPH', doc_id, coalesce(parent, i)::VARCHAR, min(i), string_agg(text, chr(10) ORDER BY i), count(*) FROM el GROUP BY doc_id, coalesce(parent, i)"""
)
def hydrated_by_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of an id list's documents as sentences, whole documents and paragraphs."""
    docs = table(spark, sf_dir, "documents")
    chunks = R.chunk(docs)
    elements = chunks.select("doc_id", F.col("pos").cast("long").alias("element_index"), F.col("pos").cast("long").alias("element_id"), F.when(F.expr("pos % 4 <> 0"), F.expr("pos div 4 * 4")).cast("long").alias("parent_id"), "text", F.expr("pos % 3 <> 2").alias("is_sentence"))
    ids = docs.where("doc_id % 2 = 0").select("doc_id")
    every = [R.hydrate_units(elements, ids, unit).select(F.lit(unit).alias("unit"), "doc_id", "unit_id", "pos", "text", "n_elements") for unit in ("SENTENCE", "DOCUMENT", "PARAGRAPH")]
    return every[0].unionByName(every[1]).unionByName(every[2])
