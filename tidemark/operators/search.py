"""Search over entity, field and metric documents: build, index, score, refresh.

A document is (doc_type, doc_id, entity_type, endpoint, snippet, boost, tenant_id, text); its key is
(doc_type, entity_type, tenant_id, doc_id), kept as one text column `doc_key`.
The index is a table of postings (token, doc_key, tf); a document's postings lie together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.text import query_tokens, tokens
from tidemark.operators.metrics import CATALOG


@dataclass(frozen=True)
class Entity:
    name: str
    plural: str
    description: str
    key: str
    fields: dict


# Fixed: entity catalog with field descriptions, and the boosts of field and metric documents.
ENTITIES = {
    "order": Entity("order", "orders", "Customer orders with status and total", "order_id", {
        "order_id": "Unique order identifier (ORD-YYYYMMDD-NNNN)", "user_id": "Customer identifier",
        "status": "Current status: pending, confirmed, shipped, delivered, cancelled",
        "total_amount": "Order total in the order currency",
        "currency": "ISO 4217 alpha-3 currency code (RUB primary; AED/KZT on branch-currency reads)",
        "created_at": "Order creation timestamp"}),
    "product": Entity("product", "products", "Product catalog with current pricing and stock", "product_id", {
        "product_id": "Unique product identifier", "name": "Product display name", "category": "Product category",
        "price": "Current price in RUB", "in_stock": "Whether the product is currently available",
        "stock_quantity": "Current inventory count"}),
    "session": Entity("session", "sessions", "User browsing sessions with funnel stage", "session_id", {
        "session_id": "Unique session identifier", "user_id": "User identifier (null for anonymous)",
        "started_at": "Session start time", "ended_at": "Session end time", "duration_seconds": "Session duration",
        "event_count": "Number of events in session", "unique_pages": "Distinct pages visited",
        "funnel_stage": "Deepest stage: bounce/browse/product_view/add_to_cart/checkout",
        "is_conversion": "Whether the session resulted in a checkout"}),
    "user": Entity("user", "users", "Customer profile with order history summary", "user_id", {
        "user_id": "Unique user identifier", "total_orders": "Lifetime order count", "total_spent": "Lifetime spend in RUB",
        "first_order_at": "First order timestamp", "last_order_at": "Most recent order timestamp",
        "preferred_category": "Most frequently ordered category"}),
}
FIELD_BOOST, METRIC_BOOST = 0.6, 1.15
ORDER_TAGS = ((300, "large large large high value premium"), (150, "large high value"))
SMALL_ORDER, SMALL_TAGS = 50, "small budget low value"
NO_STOCK_TAGS = "unavailable out stock"

DOC_COLUMNS = ["doc_type", "doc_id", "entity_type", "endpoint", "snippet", "boost", "tenant_id", "text"]


def _text(c: str) -> Column:
    """Text of a field as it appears in snippets: None for NULL, capitalised booleans."""
    return F.coalesce(F.col(c).cast("string"), F.lit("None"))


def _flag(c: str) -> Column:
    return F.coalesce(F.initcap(F.col(c).cast("string")), F.lit("None"))


def snippet(kind: str) -> Column:
    if kind == "order":
        return F.concat(F.lit("Order "), _text("order_id"), F.lit(" status "), _text("status"), F.lit(" total "), _text("total_amount"),
                        F.lit(" "), _text("currency"), F.lit(" user "), _text("user_id"))
    if kind == "product":
        stock = F.when(F.coalesce("in_stock", F.lit(False)), "in stock").otherwise("out of stock")
        return F.concat(F.lit("Product "), _text("name"), F.lit(" ("), _text("product_id"), F.lit(") category "), _text("category"),
                        F.lit(" price "), _text("price"), F.lit(" RUB "), stock)
    if kind == "user":
        return F.concat(F.lit("User "), _text("user_id"), F.lit(" with "), _text("total_orders"), F.lit(" orders spent "),
                        _text("total_spent"), F.lit(" RUB prefers "), _text("preferred_category"))
    if kind == "session":
        return F.concat(F.lit("Session "), _text("session_id"), F.lit(" for user "), _text("user_id"), F.lit(" stage "),
                        _text("funnel_stage"), F.lit(" conversion "), _flag("is_conversion"))
    raise ValueError(f"no documents for {kind}")


def tags(kind: str) -> Column:
    if kind == "order":
        amount = F.coalesce(F.col("total_amount").cast("double"), F.lit(0.0))
        out = F.when(amount <= SMALL_ORDER, SMALL_TAGS).otherwise("")
        for limit, words in reversed(ORDER_TAGS):
            out = F.when(amount >= limit, words).otherwise(out)
        return out
    if kind == "product":
        return F.when(~F.col("in_stock"), NO_STOCK_TAGS).otherwise("")
    return F.lit("")


def entity_documents(rows: DataFrame, kind: str) -> DataFrame:
    """Documents of the rows of one entity table. The tenant travels beside the text, never in it."""
    entity = ENTITIES[kind]
    payload = []
    for f in rows.schema.fields:
        if f.name == "tenant_id":
            continue
        payload.append(F.lit(f.name.replace("_", " ")))
        value = F.col(f.name)
        if f.dataType.typeName() == "timestamp":
            value = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss")
        payload.append(value.cast("string"))
    text = F.concat_ws(" ", F.lit(entity.name), F.lit(entity.plural), F.lit(entity.description), F.col("snippet"), *payload, tags(kind))
    shown = rows.filter(F.coalesce(F.col(entity.key), F.lit("")) != "").withColumn("snippet", snippet(kind))
    return shown.select(
        F.lit("entity").alias("doc_type"), F.col(entity.key).alias("doc_id"), F.lit(kind).alias("entity_type"),
        F.concat(F.lit(f"/v1/entity/{kind}/"), F.col(entity.key)).alias("endpoint"), "snippet", F.lit(1.0).alias("boost"),
        F.coalesce("tenant_id", F.lit("default")).alias("tenant_id"), text.alias("text"))


def catalog_documents(spark, metric_values: dict[str, str] | None = None) -> DataFrame:
    """Documents of catalog fields and metrics; they belong to no tenant."""
    rows = []
    for e in ENTITIES.values():
        for name, about in e.fields.items():
            doc = f"{e.name}.{name}"
            rows.append(("catalog_field", doc, e.name, "/v1/catalog", f"{doc}: {about}", FIELD_BOOST, None,
                         " ".join((e.name, e.plural, name.replace("_", " "), about))))
    for metric in CATALOG.values():
        window = "24h" if "24h" in metric.windows else metric.windows[0]
        value = (metric_values or {}).get(metric.name, f"unavailable {metric.unit}")
        shown = f"Metric {metric.name}: {metric.description}. Current value ({window}) is {value}."
        rows.append(("metric", metric.name, None, f"/v1/metrics/{metric.name}", shown, METRIC_BOOST, None, " ".join(
            ("metric", metric.name, metric.name.replace("_", " "), metric.description, metric.unit, shown))))
    return spark.createDataFrame(rows, "doc_type string, doc_id string, entity_type string, endpoint string, snippet string, "
                                       "boost double, tenant_id string, text string")


def keyed(documents: DataFrame) -> DataFrame:
    key = F.concat_ws("\x1f", "doc_type", F.coalesce("entity_type", F.lit("")), F.coalesce("tenant_id", F.lit("")), "doc_id")
    return documents.withColumn("doc_key", key)


SCORED = ["doc_type", "doc_id", "entity_type", "tenant_id", "boost"]


def postings(documents: DataFrame, only: Sequence[str] | None = None) -> DataFrame:
    """(token, doc_key, tf and what scoring and filters need of the document). No token gathers its documents.

    `only` keeps the tokens of one question before anything is shuffled.
    """
    words = tokens(F.col("text"))
    if only is not None:
        words = F.filter(words, lambda w: w.isin(*only))
    return (documents.select("doc_key", *SCORED, F.explode(words).alias("token")).groupBy("token", "doc_key", *SCORED)
            .agg(F.count("*").alias("tf")))


def segment_postings(documents: DataFrame) -> DataFrame:
    """The same postings for documents that lie in files: counted inside each row, so no occurrence is shuffled.

    Documents that share a key make one posting for each token, so those, and only those, are brought together.
    """
    again = documents.groupBy("doc_key").agg(F.count("*").alias("n")).filter(F.col("n") > 1).select("doc_key").cache()
    try:
        shared = not again.isEmpty()
    finally:
        again.unpersist()
    single = documents.join(again, "doc_key", "left_anti") if shared else documents
    sorted_words = single.select("doc_key", *SCORED, F.array_sort(tokens(F.col("text"))).alias("_words"))
    # places where a new token starts; its count is the way to the next one
    starts = F.filter(F.sequence(F.lit(0), F.size("_words") - 1), lambda i: (i == 0) | (F.get("_words", i) != F.get("_words", i - 1)))
    placed = sorted_words.filter(F.size("_words") > 0).withColumn("_starts", starts)
    counted = F.transform("_starts", lambda i, k: F.struct(
        F.get("_words", i).alias("token"), (F.coalesce(F.get("_starts", k + 1), F.size("_words")) - i).cast("long").alias("tf")))
    rows = placed.select("doc_key", *SCORED, F.inline(counted)).select("token", "doc_key", *SCORED, "tf")
    return rows.unionByName(postings(documents.join(again, "doc_key", "left_semi"))) if shared else rows


def document_frequency(index: DataFrame) -> DataFrame:
    return index.groupBy("token").agg(F.count("*").alias("df"))


def inverse_frequency(df: Column, total: Column) -> Column:
    return F.log((1 + total) / (1 + df)) + 1.0


def search(index: DataFrame, documents: DataFrame, question: str, limit: int = 10, tenant: str | None = None,
           authorised: Sequence[str] | None = None, requested: Sequence[str] | None = None, total: int | None = None) -> DataFrame:
    """Best documents of a question: filters first, then scores, then the top of the list. `total` counts the documents, if known.

    Frequencies are those of the whole corpus. Only postings of the question's tokens are read; of the documents only those
    that are shown.
    """
    wanted = query_tokens(question)
    if not wanted:
        wanted = {"": 0}
    hits = index.filter(F.col("token").isin(*wanted))
    total = F.lit(documents.agg(F.count("*").alias("n")).scalar() if total is None else total)
    # one row per question token, so the broadcast is bounded by the question
    weights = document_frequency(hits).withColumn("idf", inverse_frequency(F.col("df"), total)).select("token", "idf")
    repeats = F.create_map(*[F.lit(x) for kv in wanted.items() for x in kv])
    visible = hits
    if tenant is not None:
        visible = visible.filter(F.col("tenant_id").isNull() | (F.col("tenant_id") == tenant))
    if authorised is not None:
        visible = visible.filter(F.col("entity_type").isNull() | F.col("entity_type").isin(*authorised))
    if requested:
        visible = visible.filter((F.col("doc_type") != "metric") & F.col("entity_type").isin(*requested))
    scored = (visible.join(F.broadcast(weights), "token").groupBy("doc_key", *SCORED)
              .agg(F.sum(F.try_element_at(repeats, F.col("token")) * (1.0 + F.log("tf")) * F.col("idf")).alias("raw"),
                   F.count("*").alias("matched")))
    joined = scored.withColumn(
        "raw", F.col("raw") * (0.65 + 0.35 * F.col("matched") / len(wanted)) * F.col("boost")).filter(F.col("raw") != 0.0)
    # ties are settled on a rounded score: sums of doubles may differ in the last bits between runs
    top = joined.withColumn("_rank", F.round("raw", 9)).orderBy(F.desc("_rank"), "doc_type", "doc_id").limit(limit)
    best = F.max("raw").over(Window.partitionBy())  # at most `limit` rows
    shown = top.withColumn("score", F.round((F.col("raw") / best).cast("decimal(20,12)"), 4).cast("double"))
    return documents.select("doc_key", "snippet", "endpoint").join(F.broadcast(shown), "doc_key").select(
        F.col("doc_type").alias("type"), F.col("doc_id").alias("id"), "entity_type", "score", "snippet", "endpoint")
