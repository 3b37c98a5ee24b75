"""A versioned fact memory: an append-only log, its latest state, recall and guarded merging."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions.text import normalise_compat
from tidemill.functions.vector import safe_cosine

from . import messages
from .retrieval import nearest

EXTRACT = 'Find durable facts about the user. Return only JSON: {"facts": [{"fact_object", "fact_content", "visibility": "PUBLIC" or "PRIVATE"}]}.'
UPDATE_SIMILARITY, DELETE_SIMILARITY = 0.8, 0.9


def latest(log: DataFrame, key: str = "fact_id", seq: str = "seq", op: str = "op") -> DataFrame:
    """One row a fact from its operations add, update, delete and supersede in order of seq.

    state: SUPERSEDED or DELETED by the first such operation after the add, else ACTIVE; content: that of the last add or
    update before it. Operations before a fact's add do nothing. Sequential rules become two aggregates.
    """
    begin = log.filter(F.col(op) == "add").groupBy(key).agg(F.min(seq).alias("added"))
    live = log.join(begin, key).filter(F.col(seq) >= F.col("added"))
    ends = live.filter(F.col(op).isin("delete", "supersede")).groupBy(key).agg(F.min(F.struct(F.col(seq).alias("ended"), F.col(op).alias("how"))).alias("e")).select(key, "e.*")
    joined = live.join(ends, key, "left").filter(F.col("ended").isNull() | (F.col(seq) < F.col("ended")))
    said = joined.filter(F.col(op).isin("add", "update")).groupBy(key).agg(F.max_by("content", seq).alias("content"), F.min("added").alias("created_seq"), F.max(seq).alias("updated_seq"), F.first("how").alias("how"), F.first("ended").alias("ended"))
    state = F.when(F.col("how") == "delete", "DELETED").when(F.col("how") == "supersede", "SUPERSEDED").otherwise("ACTIVE")
    return said.select(key, "content", state.alias("state"), "created_seq", F.coalesce("ended", "updated_seq").alias("updated_seq"))


def similarity(a: Column, b: Column, embed: Callable[[Column], Column]) -> Column:
    """Cosine of two texts under an embedder, which sees a blank text as a space; 0 where a vector has no length."""
    text = lambda c: F.when(F.coalesce(c, F.lit("")) == "", " ").otherwise(c)
    return safe_cosine(embed(text(a)), embed(text(b)))


def listing(facts: DataFrame, active: bool = True, order: str = "created_seq", key: str = "fact_id") -> DataFrame:
    """Facts in order of their creation, the active ones or all."""
    return (facts.filter("state = 'ACTIVE'") if active else facts).orderBy(order, key)


def recall(queries: DataFrame, facts: DataFrame, k: int = 5, min_score: float = 0.0) -> DataFrame:
    """Active facts nearest to each query by cosine; the score limit (more than) comes after the best k."""
    active = facts.filter("state = 'ACTIVE'")
    return nearest(queries, active, k, "cosine", doc_id="fact_id").filter(F.col("score") > min_score)


def recalled(hits: DataFrame, facts: DataFrame) -> DataFrame:
    """Hits (query_id, doc_id, score, rank) with their facts' content; those whose fact is missing or not active are left out."""
    live = facts.filter("state = 'ACTIVE'").drop("score", "rank", "query_id")
    return hits.withColumnRenamed("doc_id", "fact_id").join(live, "fact_id")


def recall_for_merge(new_facts: DataFrame, facts: DataFrame, k: int = 5, by: str = "batch_id") -> DataFrame:
    """by, fact_id: the active facts near to any new fact of a batch, each once. new_facts: by, query_id, vector."""
    hits = recall(new_facts.select("query_id", "vector"), facts, k)
    return hits.join(new_facts.select("query_id", by), "query_id").select(by, F.col("doc_id").alias("fact_id")).distinct()


class VectorIndex:
    """Vectors by id as a table: add replaces what it names, remove and clear forget; each gives a new index and reads nothing."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("id", "vector")

    def add(self, rows: DataFrame) -> VectorIndex:
        new = rows.select("id", "vector")
        return VectorIndex(self.rows.join(new.select("id"), "id", "left_anti").unionByName(new))

    def remove(self, ids: DataFrame) -> VectorIndex:
        return VectorIndex(self.rows.join(ids.select("id"), "id", "left_anti"))

    def clear(self) -> VectorIndex:
        return VectorIndex(self.rows.limit(0))

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """query_id, doc_id, score (cosine) and rank."""
        return nearest(queries, self.rows, k, "cosine", doc_id="id")


def resolve(ops: DataFrame, existing: DataFrame, similarity: Column, update_at: float = UPDATE_SIMILARITY, delete_at: float = DELETE_SIMILARITY) -> DataFrame:
    """What becomes of each proposed operation (type, id, fact_content, fact_object): columns `resolved` and `applied`.

    existing: id, fact_object, fact_content of the recalled facts; `similarity` reads ops' columns and old_content. An
    update of the same slot that is alike supersedes, else its content is added; a delete needs content, the same slot and more
    likeness, else its content is added; one without content is refused.
    """
    old = existing.select(F.col("id"), F.col("fact_object").alias("old_object"), F.col("fact_content").alias("old_content"), F.lit(True).alias("known"))
    df = ops.join(old, "id", "left")
    content = F.trim(F.coalesce("fact_content", F.lit(""))) != ""
    slot = ~((F.coalesce("fact_object", F.lit("")) != "") & (F.coalesce("old_object", F.lit("")) != "") & (F.col("fact_object") != F.col("old_object")))
    like = F.when(content, similarity).otherwise(0.0)
    kind, known = F.lower(F.trim("type")), F.coalesce("known", F.lit(False))
    resolved = (
        F.when((kind == "add") & content, "add")
        .when((kind == "update") & known & content, F.when(slot & (like >= update_at), "supersede").otherwise("add"))
        .when((kind == "delete") & known & content, F.when(slot & (like >= delete_at), "delete").otherwise("add"))
        .otherwise("refused")
    )
    return df.withColumn("resolved", resolved).withColumn("applied", F.col("resolved") != "refused").drop("known")


def parsed_facts(texts: DataFrame, by: str = "query_id", raw: str = "raw") -> DataFrame:
    """by, place, fact_object, fact_content and visibility of each fact in a model's JSON; unreadable texts have none."""
    rows = texts.select(by, F.posexplode(messages.facts(F.col(raw))).alias("place", "f"))
    return rows.select(by, "place", "f.fact_object", "f.fact_content", visibility(F.col("f.visibility")).alias("visibility"))


def extract(turns: DataFrame, say: Callable[[Column, Column], Column], by: str = "query_id", text: str = "message", source: str = "chat", time: Column | None = None) -> DataFrame:
    """The facts that a model finds in each text; blank texts are not asked about. say is a model as a column function of (system, user)."""
    asked = turns.filter(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    when = F.concat(F.lit("MESSAGE TIME: "), time.cast("string")) if time is not None else F.lit(None).cast("string")
    user = F.concat_ws("\n\n", when, F.lit(f"SOURCE: {source}"), F.concat(F.lit("CONTENT:\n"), F.trim(F.col(text))))
    return parsed_facts(asked.select(by, say(F.lit(EXTRACT), user).alias("raw")), by)


def added(new_facts: DataFrame, facts: DataFrame, by: str = "task_id") -> DataFrame:
    """new_facts (by, place, fact_content) with applied: false where their batch or its memory has the same content already, made alike."""
    flat = lambda c: normalise_compat(F.col(c))
    held = facts.filter("state = 'ACTIVE'").select(by, flat("fact_content").alias("_k")).distinct().withColumn("_had", F.lit(True))
    rows = new_facts.withColumn("_k", flat("fact_content")).withColumn("_n", F.row_number().over(Window.partitionBy(by, "_k").orderBy("place")))
    return rows.join(held, [by, "_k"], "left").withColumn("applied", F.col("_had").isNull() & (F.col("_n") == 1)).drop("_k", "_n", "_had")


def add_all(new_facts: DataFrame) -> DataFrame:
    """What becomes of new facts where a model's operations can't be read: all are added, so that nothing is lost."""
    return new_facts.withColumns({"resolved": F.lit("add"), "applied": F.lit(True)})


def visibility(value: Column, numbers_as_text: bool = True) -> Column:
    """PUBLIC or PRIVATE of a word in any case or of 1 and 2, else PUBLIC; numbers written as text count only if asked for."""
    v = F.upper(F.trim(value.cast("string")))
    out = F.when(v.isin("PUBLIC", "PRIVATE"), v)
    if numbers_as_text:
        out = out.when(v == "1", "PUBLIC").when(v == "2", "PRIVATE")
    return out.otherwise(F.lit("PUBLIC"))


def block(facts: DataFrame, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """A query's facts as one text, a line each, in order."""
    about = F.when(F.coalesce("fact_object", F.lit("")) != "", F.concat(F.lit("("), F.col("fact_object"), F.lit(") "))).otherwise("")
    line = F.concat(F.lit("- "), about, F.col("content"))
    return facts.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, line.alias("line")))), lambda x: x["line"]), "\n").alias("memory"))
