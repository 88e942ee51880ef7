"""Queries of search, templated questions and result comparison."""

from __future__ import annotations

import functools
from datetime import timedelta

from pyspark.sql import functions as F

from tidemark.functions.columns import at, iso, money, rounded
from tidemark.functions.enrich import page_category
from tidemark.functions.text import STOP_WORDS, query_tokens, tokens
from tidemark.operators import compare as cmp
from tidemark.operators import questions as qs
from tidemark.operators import search as se
from tidemark.operators.maintenance import changed_buckets, fingerprints, of_buckets
from tidemark.operators.segments import SegmentedIndex
from tidemark.operators.serving import user_profiles
from tidemark.operators.sessions import fold_sessions
from tidemark.operators.tenancy import tenant_scope
from tidemark.plans.metrics import SERVING_SESSIONS, serving_sessions
from tidemark.plans.registry import Inputs, Load, dec_round, query, ts_text
from tidemark.plans.serving import _CATEGORY
from tidemark.session import cut_lineage, work_dir
from tidemark.sources import files

NOW = "(SELECT max(ts) FROM events)"
ORDERS_NOW = "(SELECT max(created_at) FROM a_orders)"

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"


def token_sql(text: str) -> str:
    return f"""list_filter(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda t: CASE WHEN t IN ('status', 'statuses') THEN 'status'
 WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END),
 lambda t: NOT list_contains({_STOP}, t))"""


@query("q01_tokens", f"SELECT doc_id, len(tk) AS tokens, len(list_distinct(tk)) AS distinct_tokens, md5(array_to_string(tk, ' ')) AS fingerprint FROM (SELECT doc_id, {token_sql('text')} AS tk FROM documents)")
def token_lists(t: Inputs):
    words = tokens(F.col("text"))
    return t.documents.select("doc_id", words.alias("tk")).select(
        "doc_id", F.size("tk").alias("tokens"), F.size(F.array_distinct("tk")).alias("distinct_tokens"), F.md5(F.array_join("tk", " ")).alias("fingerprint"))


# What the documents of an entity are made of: the view, and the id by which its rows belong to a document.
ENTITY_VIEWS = {"order": ("a_orders", "order_id"), "product": ("a_products", "product_id"), "user": ("a_orders", "user_id"),
                "session": ("a_events", "coalesce(session_id, 'unknown')")}


def documents_of(rows, kind: str):
    """Documents of one entity from the rows of its view; a document is made of all rows of its id."""
    if kind == "order":
        rows = rows.select("tenant_id", "order_id", "user_id", "status", "total_amount", "currency", "created_at")
    elif kind == "product":
        rows = rows.select("tenant_id", "product_id", "name", "category", "price", "in_stock", "stock_quantity")
    elif kind == "user":
        rows = user_profiles(rows).select("tenant_id", "user_id", "total_orders", "total_spent", "first_order_at", "last_order_at", "preferred_category")
    else:
        rows = fold_sessions(rows.withColumn("page_category", page_category(F.col("page_url")))).select(
            "tenant_id", "session_id", "user_id", "started_at", "ended_at", "duration_seconds", "event_count", "unique_pages", "funnel_stage", "is_conversion")
    return se.entity_documents(rows, kind)


def _union(parts):
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


def entity_corpus(t: Inputs):
    """Documents of orders, products, users and sessions, and of the catalog."""
    return _union([*(documents_of(t.table(view), kind) for kind, (view, _) in ENTITY_VIEWS.items()), se.catalog_documents(t.spark)])


INDEX_TABLES = ("orders", "part", "events")


def entity_index(t: Inputs) -> SegmentedIndex:
    """The index of the entities, built once for this application and folder; changed entities come as segments."""
    loads, now = t.loads(), t.version(INDEX_TABLES)
    if "index" not in loads:
        loads["index"] = Load(work_dir(t.spark, "index"), now, {kind: _noted(t, kind) for kind in ENTITY_VIEWS})
        SegmentedIndex(t.spark, loads["index"].path).add(se.keyed(entity_corpus(t)))
    load = loads["index"]
    index = SegmentedIndex(t.spark, load.path)
    if load.version != now:
        fresh, taken = [], []
        old = index.documents()
        for kind, (view, id) in ENTITY_VIEWS.items():
            noted = _noted(t, kind)
            buckets = cut_lineage(changed_buckets(t.spark.read.parquet(load.prints[kind]), t.spark.read.parquet(noted)))
            fresh.append(documents_of(of_buckets(t.table(view), F.expr(id), buckets), kind))
            taken.append(of_buckets(old.filter(F.col("entity_type") == kind).filter(F.col("doc_type") == "entity"), F.col("doc_id"), buckets).select("doc_key"))
            files.remove(t.spark, [load.prints[kind]])
            load.prints[kind] = noted
        index.add(se.keyed(_union(fresh)), cut_lineage(_union(taken)))
        load.version = now
    return index


def _noted(t: Inputs, kind: str) -> str:
    path, (view, id) = work_dir(t.spark, f"prints-{kind}"), ENTITY_VIEWS[kind]
    fingerprints(t.table(view), F.expr(id)).coalesce(1).write.parquet(path)
    return path


def _catalog_sql() -> str:
    """The catalog documents as literal rows; they are configuration."""
    rows = []
    q = lambda v: "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"
    for e in se.ENTITIES.values():
        for name, about in e.fields.items():
            rows.append(("catalog_field", f"{e.name}.{name}", e.name, se.FIELD_BOOST, " ".join((e.name, e.plural, name.replace("_", " "), about))))
    for m in se.CATALOG.values():
        w = "24h" if "24h" in m.windows else m.windows[0]
        shown = f"Metric {m.name}: {m.description}. Current value ({w}) is unavailable {m.unit}."
        rows.append(("metric", m.name, None, se.METRIC_BOOST, " ".join(("metric", m.name, m.name.replace("_", " "), m.description, m.unit, shown))))
    return ",\n".join(f"({q(a)}, {q(b)}, {q(c)}, NULL, {d}, {q(x)})" for a, b, c, d, x in rows)


_O_SNIP = "'Order ' || order_id || ' status ' || status || ' total ' || CAST(total_amount AS VARCHAR) || ' ' || currency || ' user ' || user_id"
_P_SNIP = "'Product ' || name || ' (' || product_id || ') category ' || category || ' price ' || CAST(price AS VARCHAR) || ' RUB ' || CASE WHEN in_stock THEN 'in stock' ELSE 'out of stock' END"
_S_SNIP = "'Session ' || session_id || ' for user ' || coalesce(user_id, 'None') || ' stage ' || funnel_stage || ' conversion ' || CASE WHEN is_conversion THEN 'True' ELSE 'False' END"
_U_SNIP = "'User ' || user_id || ' with ' || total_orders || ' orders spent ' || CAST(total_spent AS VARCHAR) || ' RUB prefers None'"
_SESSIONS = f"""ranked AS (SELECT *, coalesce(session_id, 'unknown') AS sid, {_CATEGORY} AS cat FROM a_events),
stages AS (SELECT *, CASE cat WHEN 'checkout' THEN 4 WHEN 'cart' THEN 3 WHEN 'product_detail' THEN 2 WHEN 'search' THEN 1 ELSE 0 END AS rk FROM ranked),
sessions AS (SELECT tenant_id, sid AS session_id, first(user_id ORDER BY ts, src_key) AS user_id, min(ts) AS started_at, count(*) AS event_count,
  first(cat ORDER BY rk DESC, ts, src_key) AS funnel_stage, first(cat ORDER BY rk DESC, ts, src_key) = 'checkout' AS is_conversion FROM stages GROUP BY tenant_id, sid)"""
_DOCS = f"""{_SESSIONS}, docs AS (
 SELECT 'entity' AS doc_type, order_id AS doc_id, 'order' AS entity_type, tenant_id, 1.0 AS boost,
   concat_ws(' ', 'order', 'orders', 'Customer orders with status and total', {_O_SNIP}, 'order id', order_id, 'user id', user_id, 'status', status, 'total amount', CAST(total_amount AS VARCHAR),
     'currency', currency, 'created at', strftime(created_at, '%Y-%m-%dT%H:%M:%S'), CASE WHEN total_amount >= 300 THEN 'large large large high value premium' WHEN total_amount >= 150 THEN 'large high value' WHEN total_amount <= 50 THEN 'small budget low value' ELSE '' END) AS text FROM a_orders
 UNION ALL SELECT 'entity', product_id, 'product', tenant_id, 1.0, concat_ws(' ', 'product', 'products', 'Product catalog with current pricing and stock', {_P_SNIP}, 'product id', product_id, 'name', name, 'category', category,
     'price', CAST(price AS VARCHAR), 'in stock', CAST(in_stock AS VARCHAR), 'stock quantity', CAST(stock_quantity AS VARCHAR), CASE WHEN NOT in_stock THEN 'unavailable out stock' ELSE '' END) FROM a_products
 UNION ALL SELECT 'entity', user_id, 'user', tenant_id, 1.0, concat_ws(' ', 'user', 'users', 'Customer profile with order history summary', {_U_SNIP}, 'user id', user_id, 'total orders', CAST(total_orders AS VARCHAR),
     'total spent', CAST(total_spent AS VARCHAR), 'first order at', strftime(first_order_at, '%Y-%m-%dT%H:%M:%S'), 'last order at', strftime(last_order_at, '%Y-%m-%dT%H:%M:%S'), 'preferred category', '') FROM a_users
 UNION ALL SELECT 'entity', session_id, 'session', tenant_id, 1.0, concat_ws(' ', 'session', 'sessions', 'User browsing sessions with funnel stage', {_S_SNIP}, 'session id', session_id, 'user id', user_id,
     'started at', strftime(started_at, '%Y-%m-%dT%H:%M:%S'), 'ended at', 'duration seconds', '0.0', 'event count', CAST(event_count AS VARCHAR), 'unique pages', '1', 'funnel stage', funnel_stage,
     'is conversion', CAST(is_conversion AS VARCHAR), '') FROM sessions
 UNION ALL SELECT * FROM (VALUES {_catalog_sql()}) AS c(doc_type, doc_id, entity_type, tenant_id, boost, text))"""


@query("q02_entity_documents", f"WITH {_DOCS} SELECT doc_type, doc_id, entity_type, tenant_id, CAST(boost AS DOUBLE) AS boost, md5(array_to_string({token_sql('text')}, ' ')) AS fingerprint FROM docs")
def entity_documents(t: Inputs):
    return entity_corpus(t).select("doc_type", "doc_id", "entity_type", "tenant_id", "boost", F.md5(F.array_join(tokens(F.col("text")), " ")).alias("fingerprint"))


def text_corpus(t: Inputs):
    """The document table as a corpus of its own; the source stands for the type."""
    return se.keyed(t.documents.select(
        F.lit("entity").alias("doc_type"), F.format_string("%010d", "doc_id").alias("doc_id"), F.col("source").alias("entity_type"),
        F.lit("").alias("endpoint"), F.col("lang").alias("snippet"), F.lit(1.0).alias("boost"), F.lit("default").alias("tenant_id"), "text"))


@query("q04_inverse_frequency", f"""
WITH tk AS (SELECT DISTINCT doc_id, unnest({token_sql('text')}) AS token FROM documents)
SELECT token, count(*) AS df, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1.0, 8) AS idf FROM tk GROUP BY token""")
def inverse_frequency(t: Inputs):
    docs = text_corpus(t)
    total = F.lit(docs.agg(F.count("*").alias("n")).scalar())
    return se.document_frequency(se.postings(docs)).select("token", "df", F.round(se.inverse_frequency(F.col("df"), total), 8).alias("idf"))


def _search_sql(docs: str, question: str, limit: int, where: str = "true", columns: str = "doc_type AS type, doc_id AS id, entity_type") -> str:
    wanted = query_tokens(question)
    values = ", ".join(f"('{w}', {n})" for w, n in wanted.items())
    return f"""WITH {docs}, q(token, n) AS (VALUES {values}),
 tk AS (SELECT doc_type, doc_id, entity_type, tenant_id, boost, unnest({token_sql('text')}) AS token FROM docs),
 tf AS (SELECT doc_type, doc_id, entity_type, tenant_id, boost, token, count(*) AS tf FROM tk WHERE token IN (SELECT token FROM q) GROUP BY ALL),
 idf AS (SELECT token, ln((1 + (SELECT count(*) FROM docs)) / (1 + count(*))) + 1.0 AS idf FROM tf GROUP BY token),
 sc AS (SELECT doc_type, doc_id, entity_type, sum(q.n * (1 + ln(tf)) * idf) * (0.65 + 0.35 * count(*) / {len(wanted)}) * boost AS raw
   FROM tf JOIN idf USING (token) JOIN q USING (token) WHERE {where} GROUP BY doc_type, doc_id, entity_type, tenant_id, boost),
 top AS (SELECT * FROM sc ORDER BY round(raw, 9) DESC, doc_type, doc_id LIMIT {limit})
SELECT {columns}, {dec_round('raw / (SELECT max(raw) FROM top)', 4)} AS score FROM top"""


_TEXT_DOCS = "docs AS (SELECT 'entity' AS doc_type, printf('%010d', doc_id) AS doc_id, source AS entity_type, 'default' AS tenant_id, 1.0 AS boost, text FROM documents)"
TEXT_QUESTION = "the licenses and statuses of an open source software copyright notice"
ENTITY_QUESTION = "large premium delivered orders with status shipped and revenue of users"


@query("q05_search_text", _search_sql(_TEXT_DOCS, TEXT_QUESTION, 20))
def search_text(t: Inputs):
    docs = text_corpus(t)
    index = cut_lineage(se.postings(docs, list(query_tokens(TEXT_QUESTION))))  # texts are read once, and not kept
    return se.search(index, docs, TEXT_QUESTION, 20).drop("snippet", "endpoint")


@query("q05_search_entities", _search_sql(_DOCS, ENTITY_QUESTION, 25))
def search_entities(t: Inputs):
    return entity_index(t).search(ENTITY_QUESTION, 25).drop("snippet", "endpoint")


@query("q06_filtered_search", _search_sql(
    _DOCS, ENTITY_QUESTION, 25, "(tenant_id IS NULL OR tenant_id = 'acme') AND (entity_type IS NULL OR entity_type IN ('user', 'product', 'session'))"))
def filtered_search(t: Inputs):
    return entity_index(t).search(ENTITY_QUESTION, 25, tenant="acme", authorised=["user", "product", "session"]).drop("snippet", "endpoint")


def refreshed_index(t: Inputs) -> SegmentedIndex:
    """The index of an earlier state, and the changes since then in two more segments.

    Earlier: orders before the last 300 days, events before the last ten, products that were listed then. The changed ids are
    those of the rows since, the products they name, and the users of the orders.
    """
    orders_cut, events_cut = at(t.orders_as_of - timedelta(days=300)), at(t.events_as_of - timedelta(days=10))
    new = {"a_orders": F.col("created_at") >= orders_cut, "a_events": F.col("ts") >= events_cut, "a_products": F.col("src_key") % 10 == 3}
    index = SegmentedIndex(t.spark, work_dir(t.spark, "segments"))
    before = [documents_of(t.table(view).filter(~new[view]), kind) for kind, (view, _) in ENTITY_VIEWS.items()]
    index.add(se.keyed(_union([*before, se.catalog_documents(t.spark)])))
    for kinds in (("order", "user"), ("session", "product")):
        fresh = []
        for kind in kinds:
            view, id = ENTITY_VIEWS[kind]
            ids = t.table(view).filter(new[view]).select(F.expr(id).alias("_id"))
            if kind == "product":
                ids = ids.unionByName(t.a_events.filter(new["a_events"] & F.col("product_id").isNotNull()).select(F.col("product_id").alias("_id")))
            fresh.append(documents_of(t.table(view).join(ids.distinct(), F.expr(id) == F.col("_id"), "left_semi"), kind))
        documents = cut_lineage(se.keyed(_union(fresh)))
        index.add(documents, documents.select("doc_key"))
    return index


@query("q07_index_refresh", f"WITH {_DOCS} SELECT doc_type, doc_id, entity_type, tenant_id, CAST(boost AS DOUBLE) AS boost, md5(array_to_string({token_sql('text')}, ' ')) AS fingerprint FROM docs")
def index_refresh(t: Inputs):
    """What is live after the refresh is what the present tables give."""
    return refreshed_index(t).documents().select("doc_type", "doc_id", "entity_type", "tenant_id", "boost", F.md5(F.array_join(tokens(F.col("text")), " ")).alias("fingerprint"))


SESSION_QUESTION = "sessions with checkout conversion of users who browse products and cart stage"


@query("q07_segment_search", _search_sql(_DOCS, SESSION_QUESTION, 25))
def segment_search(t: Inputs):
    """Scores over base, delta segments and taken documents are those of a whole index."""
    return refreshed_index(t).search(SESSION_QUESTION, 25).drop("snippet", "endpoint")


@query("q07_segment_frequency", f"""WITH {_DOCS}, tk AS (SELECT DISTINCT doc_type, entity_type, tenant_id, doc_id, unnest({token_sql('text')}) AS token FROM docs)
SELECT token, count(*) AS df FROM tk GROUP BY token""")
def segment_frequency(t: Inputs):
    return se.document_frequency(refreshed_index(t).postings())


# --- questions -----------------------------------------------------------------------------------------

# Every question is one tenant's: tables are read through the scope, here and in the check SQL.
TENANT = "default"


def scoped(df):
    return tenant_scope(df, TENANT)


def _own(table: str) -> str:
    return f"(SELECT * FROM {table} WHERE coalesce(tenant_id, 'default') = '{TENANT}')"


@query("q08_order_by_id", f"SELECT order_id, status, CAST(total_amount AS DOUBLE) AS total_amount FROM {_own('a_orders')} WHERE order_id = (SELECT max(order_id) FROM {_own('a_orders')})")
def q_order(t: Inputs):
    probe = scoped(t.a_orders).agg(F.max("order_id").alias("i"))
    return qs.order_by_id(scoped(t.a_orders), probe.scalar()).select("order_id", "status", money("total_amount").alias("total_amount"))


_LIVE = f"FROM {_own('a_orders')} WHERE status <> 'cancelled' AND created_at >= {ORDERS_NOW} - INTERVAL 7 DAY"


@query("q08_revenue", f"SELECT CAST(sum(total_amount) AS DOUBLE) AS revenue {_LIVE}")
def q_revenue(t: Inputs):
    return qs.revenue_in_window(scoped(t.a_orders), t.orders_as_of, 7 * 86400)


@query("q08_average_order", f"SELECT {dec_round('CAST(sum(total_amount) AS DOUBLE) / count(*)', 6)} AS avg_order_value {_LIVE}")
def q_average(t: Inputs):
    return qs.average_order(scoped(t.a_orders), t.orders_as_of, 7 * 86400).select(rounded("avg_order_value", 6).alias("avg_order_value"))


@query("q08_top_products", f"SELECT name, category, CAST(price AS DOUBLE) AS price, stock_quantity FROM (SELECT * FROM {_own('a_products')} ORDER BY price DESC, product_id LIMIT 7)")
def q_top(t: Inputs):
    return qs.top_products(scoped(t.a_products), 7).withColumn("price", money("price"))


@query("q08_conversions", f"""SELECT count(*) FILTER (WHERE is_conversion) AS conversions, count(*) AS total_sessions,
 {dec_round('CAST(count(*) FILTER (WHERE is_conversion) AS DOUBLE) / nullif(count(*), 0) * 100', 2)} AS conversion_pct FROM {_own('a_sessions')} WHERE started_at >= {NOW} - INTERVAL 3 DAY""")
def q_conversions(t: Inputs):
    return qs.conversions(scoped(t.a_sessions), t.events_as_of, 3 * 86400)


@query("q08_user_by_id", f"SELECT user_id, total_orders, CAST(total_spent AS DOUBLE) AS total_spent FROM {_own('a_users')} WHERE user_id = (SELECT max(user_id) FROM {_own('a_users')})")
def q_user(t: Inputs):
    probe = scoped(t.a_users).agg(F.max("user_id").alias("i"))
    return qs.user_by_id(scoped(t.a_users), probe.scalar()).select("user_id", "total_orders", money("total_spent").alias("total_spent"))


@query("q08_out_of_stock", f"SELECT product_id, name, category, stock_quantity FROM {_own('a_products')} WHERE NOT in_stock OR stock_quantity = 0")
def q_stock(t: Inputs):
    return qs.out_of_stock(scoped(t.a_products))


@query("q08_active_sessions", f"SELECT count(*) AS active_sessions FROM {SERVING_SESSIONS} WHERE tenant_id = '{TENANT}' AND (ended_at IS NULL OR ended_at >= {NOW} - INTERVAL 30 MINUTE)")
def q_active(t: Inputs):
    return qs.active_sessions(scoped(serving_sessions(t)), t.events_as_of)


_Q9 = {
    "cancelled_count": f"SELECT count(*)::VARCHAR AS a FROM {_own('a_orders')} WHERE status = 'cancelled'",
    "orders_per_status": f"SELECT status || '=' || count(*) AS a FROM {_own('a_orders')} GROUP BY status",
    "dearest_product": f"SELECT name AS a FROM (SELECT name FROM {_own('a_products')} ORDER BY price DESC, product_id LIMIT 1)",
    "products_in_category": f"SELECT count(*)::VARCHAR AS a FROM {_own('a_products')} WHERE category = 'ECONOMY'",
    "order_total": f"SELECT count(*)::VARCHAR AS a FROM {_own('a_orders')}",
    "top_spender": f"SELECT user_id AS a FROM (SELECT user_id FROM {_own('a_users')} ORDER BY total_spent DESC, user_id LIMIT 1)",
    "average_price": f"SELECT printf('%.4f', {dec_round('CAST(sum(price) AS DOUBLE) / count(*)', 4)}) AS a FROM {_own('a_products')}",
    "converted_sessions": f"SELECT count(*)::VARCHAR AS a FROM {_own('a_sessions')} WHERE is_conversion",
    "categories": f"SELECT DISTINCT category AS a FROM {_own('a_products')}",
    "user_count": f"SELECT count(*)::VARCHAR AS a FROM {_own('a_users')}",
}


@query("q09_reference_questions", " UNION ALL ".join(f"SELECT '{k}' AS question, a AS answer FROM ({v})" for k, v in _Q9.items()))
def reference_questions(t: Inputs):
    text = lambda c: F.col(c).cast("string")
    answers = {
        "cancelled_count": qs.cancelled_count(scoped(t.a_orders)).select(text("n").alias("a")),
        "orders_per_status": qs.orders_per_status(scoped(t.a_orders)).select(F.concat_ws("=", "status", text("n")).alias("a")),
        "dearest_product": qs.dearest_product(scoped(t.a_products)).select(F.col("name").alias("a")),
        "products_in_category": qs.products_in_category(scoped(t.a_products), "ECONOMY").select(text("n").alias("a")),
        "order_total": qs.order_total(scoped(t.a_orders)).select(text("n").alias("a")),
        "top_spender": qs.top_spender(scoped(t.a_users)).select(F.col("user_id").alias("a")),
        "average_price": qs.average_price(scoped(t.a_products)).select(F.format_string("%.4f", rounded("avg_price", 4)).alias("a")),
        "converted_sessions": qs.converted_sessions(scoped(t.a_sessions)).select(text("n").alias("a")),
        "categories": qs.categories(scoped(t.a_products)).select(F.col("category").alias("a")),
        "user_count": qs.user_count(scoped(t.a_users)).select(text("n").alias("a")),
    }
    out = None
    for name, df in answers.items():
        row = df.select(F.lit(name).alias("question"), F.col("a").alias("answer"))
        out = row if out is None else out.unionByName(row)
    return out


# --- comparison ------------------------------------------------------------------------------------------

@query("u05_result_equality", """
SELECT 'same' AS pair, true AS match, 0 AS left_only, 0 AS right_only
UNION ALL SELECT 'shifted', false, (SELECT count(*) FROM (SELECT DISTINCT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P')),
  (SELECT count(*) FROM (SELECT DISTINCT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'P'))""")
def result_equality(t: Inputs):
    """Orders against copies: one differs below the tolerance, one above it for part of the rows."""
    base = t.orders.select("o_orderkey", "o_totalprice")
    near = t.orders.select(F.col("o_orderkey").alias("k"), (F.col("o_totalprice") + 1e-8).alias("v"))
    far = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice")).alias("v"))
    return cmp.same_rows(base, near).select(F.lit("same").alias("pair"), "*").unionByName(
        cmp.same_rows(base, far).select(F.lit("shifted").alias("pair"), "*"))


@query("u05_ordered_equality", """
SELECT 'same' AS pair, true AS match, 0 AS different
UNION ALL SELECT 'reversed', false, (SELECT count(*) FROM (SELECT row_number() OVER (ORDER BY event_id) AS a, row_number() OVER (ORDER BY event_id DESC) AS b FROM events) WHERE a <> b)""")
def ordered_equality(t: Inputs):
    base = t.events.select("event_id", "value")
    back = base.withColumn("neg", -F.col("event_id"))
    same = cmp.same_order(base, ["event_id"], base, ["event_id"])
    turned = cmp.same_order(base.select("event_id"), ["event_id"], back.select("event_id", "neg").select("event_id"), [F.desc("event_id")])
    return same.select(F.lit("same").alias("pair"), "*").unionByName(turned.select(F.lit("reversed").alias("pair"), "*"))
