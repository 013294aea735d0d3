"""Support-message queries over ``conversations``.

``support_turns`` is every user turn of ``conversations`` with its own text; the rules that read a single text
also run over ``documents`` (``document_message_scan``).  Branches: policy turns retrieve from the fixed knowledge
base, risk turns score their resolved features with the closed-form model and bucket at its threshold on the
test split, image turns look their file name up among the exported pictures (the first of each class, E13) and
classify that vector with the nearest-centroid scorer.
"""
from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import literal_scan as LS
from kestrel.functions import policy_kb as KB
from kestrel.functions import text_rules as T
from kestrel.functions.rules import CATEGORIES, PAYMENT_METHODS
from kestrel.operators import messages as MS
from kestrel.operators import multiclass as MC
from kestrel.operators import retrieval as RT
from kestrel.plans.orders_plans import t_star
from kestrel.plans.registry import ORACLE, register
from kestrel.plans.retrieval_plans import term_sql
from kestrel.session import new_folder
from kestrel.sources.tables import read_table, spread


def support_turns(spark, sf_dir) -> DataFrame:
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.where(F.col("role") == "user").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


def resolved_turns(spark, sf_dir) -> DataFrame:
    return MS.carry_context(MS.guard_and_route(support_turns(spark, sf_dir)))


def policy_retrieval(turns: DataFrame) -> DataFrame:
    """The three best chunks of the knowledge base for every policy turn."""
    asked = turns.where(F.col("intent") == T.POLICY).select("conv_id", "turn", "text")
    scored = RT.scores_against_fixed_chunks(asked, ["conv_id", "turn"], KB.chunks())
    return RT.best(scored, ["conv_id", "turn"], "chunk_id")


def answered_turns(spark, sf_dir) -> DataFrame:
    t = t_star(spark, sf_dir)
    turns = resolved_turns(spark, sf_dir)
    turns = turns.withColumn("risk_p", F.when(F.col("intent") == T.RISK, MS.score_features(F.col("order_features"))))
    turns = turns.withColumn("t_star_rf", F.lit(float(t)))
    top12 = policy_retrieval(turns).groupBy("conv_id", "turn").agg(*[
        e for r in (1, 2) for e in (
            F.max(F.when(F.col("rank") == r, F.col("score"))).alias(f"top{r}_score"),
            F.max(F.when(F.col("rank") == r, F.col("doc_id"))).alias(f"top{r}_doc"),
            F.max(F.when(F.col("rank") == r, F.col("chunk_text"))).alias(f"top{r}_text"),
        )], F.sort_array(F.collect_list(F.struct("rank", "chunk_id", "score", "chunk_text"))).alias("retrieved"))  # TOP_K chunks
    turns = turns.join(top12, ["conv_id", "turn"], "left")
    # image branch: the pictures that exist are the exported ones, one for each class
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    pictures = MC.first_per_class(emb, "label", "vec_id", T.CLASS_NAMES)
    img = MS.softmax_classify(emb.join(F.broadcast(pictures.select("vec_id", "file_name")), "vec_id"), MS.class_centroids(emb))
    turns = turns.withColumn("file_name", F.substring_index("image_path", "/", -1))
    turns = turns.join(F.broadcast(img.select("file_name", "predicted_class", "confidence")), "file_name", "left")  # a row for each class
    return MS.compose_answer(turns, t)


# ---------------------------------------------------------------------------------- oracle
SPACE_SQL = r"[\s\v\x{85}\p{Z}]"  # white space of Unicode, as the rules use it


def _turns_sql() -> str:
    return "support_turns AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations WHERE role = 'user')"


def _inj_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{p}', 'i') THEN '{p}'" for p in T.INJECTION_PATTERNS) + " END"


def _exemplar_sql(col: str) -> str:
    toks = f"list_distinct(list_filter(regexp_split_to_array(lower({col}), '{SPACE_SQL}+'), lambda t: t <> ''))"
    arms = []
    for ex, intent in T.FEW_SHOT_EXAMPLES:
        lst = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(ex.split())) + "]"
        arms.append(f"WHEN len(list_distinct(list_intersect({toks}, {lst}))) >= {T.EXEMPLAR_MIN_OVERLAP} THEN '{intent}'")
    return "CASE " + " ".join(arms) + " END"


def _any_sql(col: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({col}), '{w}')" for w in words) + ")"


def _keyword_sql(col: str) -> str:
    return (f"CASE WHEN {_any_sql(col, T.IMAGE_KEYWORDS)} THEN '{T.IMAGE}' WHEN {_any_sql(col, T.RISK_KEYWORDS)} "
            f"THEN '{T.RISK}' WHEN {_any_sql(col, T.POLICY_KEYWORDS)} THEN '{T.POLICY}' END")


def _features_sql(col: str) -> dict:
    from kestrel.functions.rules import CATEGORIES, PAYMENT_METHODS
    d = T.DEFAULT_ORDER_FEATURES
    cat = "CASE " + " ".join(f"WHEN contains(lower({col}), '{c.lower()}') THEN '{c}'" for c in CATEGORIES) + " END"
    pay = "CASE " + " ".join(
        f"WHEN contains(lower({col}), '{p.lower().replace('_', ' ')}') OR contains(lower({col}), '{p.lower()}') THEN '{p}'"
        for p in PAYMENT_METHODS) + " END"
    return {
        "price_inr": f"coalesce(CAST(nullif(regexp_extract({col}, '(?i){T.PRICE_PATTERN}', 1), '') AS DOUBLE), {d['price_inr']})",
        "discount_pct": f"coalesce(CAST(nullif(regexp_extract({col}, '(?i){T.DISCOUNT_PATTERN}', 1), '') AS DOUBLE), {d['discount_pct']})",
        "product_category": f"coalesce({cat}, '{d['product_category']}')",
        "payment_method": f"CASE WHEN {_any_sql(col, T.CASH_ON_DELIVERY)} THEN 'COD' ELSE coalesce({pay}, '{d['payment_method']}') END",
    }


def _mentions_sql(col: str) -> str:
    from kestrel.functions.rules import CATEGORIES
    return (f"(regexp_matches({col}, '(?i)(?:price|₹|rs\\.?)\\s*\\d{{3,7}}') OR "
            f"{_any_sql(col, [c.lower() for c in CATEGORIES])})")


def _routed_sql() -> str:
    return f"""{_turns_sql()},
g AS (SELECT *, {_inj_sql('text')} AS injection_pattern FROM support_turns),
g2 AS (SELECT *, injection_pattern IS NOT NULL AS blocked, {_exemplar_sql('text')} AS ex_intent, {_keyword_sql('text')} AS kw_intent FROM g),
routed AS (
  SELECT conv_id, turn, text, injection_pattern, blocked,
         CASE WHEN NOT blocked THEN coalesce(ex_intent, kw_intent, '{T.POLICY}') END AS intent,
         CASE WHEN NOT blocked THEN CASE WHEN ex_intent IS NOT NULL THEN 'few_shot_match'
              WHEN kw_intent IS NOT NULL THEN 'keyword_fallback' ELSE 'default_fallback' END END AS intent_method,
         CASE WHEN blocked THEN 'deflect' WHEN coalesce(ex_intent, kw_intent, '{T.POLICY}') = '{T.POLICY}' THEN 'retrieve'
              ELSE 'tool' END AS route
  FROM g2),
ctx0 AS (
  SELECT *, {_mentions_sql('text')} AS mentions_details,
         CASE WHEN intent = '{T.RISK}' AND {_mentions_sql('text')} THEN text END AS detail_text,
         CASE WHEN intent = '{T.RISK}' THEN text END AS risk_text,
         CASE WHEN intent = '{T.IMAGE}' THEN nullif(regexp_extract(text, '{T.IMAGE_PATH_PATTERN}', 1), '') END AS path_here
  FROM routed),
ctx1 AS (
  SELECT *,
    last_value(detail_text IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_detail,
    first_value(risk_text IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS first_risk,
    last_value(path_here IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_path
  FROM ctx0),
ctx AS (
  SELECT *, CASE WHEN intent = '{T.RISK}' THEN coalesce(last_detail, first_risk) END AS src,
         CASE WHEN intent = '{T.IMAGE}' THEN last_path END AS image_path
  FROM ctx1)"""


def _resolved_sql() -> str:
    f = _features_sql("src")
    return _routed_sql() + f""",
resolved AS (
  SELECT conv_id, turn, text, intent_method, blocked, injection_pattern, intent, route, image_path, mentions_details, src,
         CASE WHEN intent = '{T.RISK}' THEN {f['price_inr']} END AS price_inr,
         CASE WHEN intent = '{T.RISK}' THEN {f['discount_pct']} END AS discount_pct,
         CASE WHEN intent = '{T.RISK}' THEN {f['product_category']} END AS product_category,
         CASE WHEN intent = '{T.RISK}' THEN {f['payment_method']} END AS payment_method
  FROM ctx)"""


# ----------------------------------------------------------------------------------- queries
@register("injection_filter", f"WITH {_turns_sql()} SELECT conv_id, turn, {_inj_sql('text')} IS NOT NULL AS blocked, "
          f"{_inj_sql('text')} AS injection_pattern FROM support_turns")
def q_injection_filter(spark, sf_dir):
    pat = T.injection_pattern(F.col("text"))
    return support_turns(spark, sf_dir).select("conv_id", "turn", pat.isNotNull().alias("blocked"),
                                               pat.alias("injection_pattern"))


@register("injection_scan_raw", f"SELECT conv_id, turn, role, {_inj_sql('text')} AS injection_pattern, "
          "CAST(length(text) AS INTEGER) AS n_chars FROM conversations")
def q_injection_scan_raw(spark, sf_dir):
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "role", "text"])
    return conv.select("conv_id", "turn", "role", T.injection_pattern(F.col("text")).alias("injection_pattern"),
                       F.length("text").alias("n_chars"))


@register("intent_exemplar", f"WITH {_turns_sql()} SELECT conv_id, turn, {_exemplar_sql('text')} AS exemplar_intent "
          "FROM support_turns")
def q_intent_exemplar(spark, sf_dir):
    return support_turns(spark, sf_dir).select("conv_id", "turn", T.exemplar_intent(F.col("text")).alias("exemplar_intent"))


@register("intent_keyword", f"WITH {_turns_sql()} SELECT conv_id, turn, {_keyword_sql('text')} AS keyword_intent "
          "FROM support_turns")
def q_intent_keyword(spark, sf_dir):
    return support_turns(spark, sf_dir).select("conv_id", "turn", T.keyword_intent(F.col("text")).alias("keyword_intent"))


@register("intent_classify", f"WITH {_routed_sql()} SELECT conv_id, turn, intent, intent_method FROM routed")
def q_intent_classify(spark, sf_dir):
    return MS.guard_and_route(support_turns(spark, sf_dir)).select("conv_id", "turn", "intent", "intent_method")


@register("route_counts", f"WITH {_routed_sql()} SELECT route, intent, count(*) AS n FROM routed GROUP BY route, intent")
def q_route_counts(spark, sf_dir):
    return MS.guard_and_route(support_turns(spark, sf_dir)).groupBy("route", "intent").agg(F.count(F.lit(1)).alias("n"))


_FX = _features_sql("text")


@register("extract_order_features", f"WITH {_turns_sql()} SELECT conv_id, turn, {_FX['price_inr']} AS price_inr, "
          f"{_FX['discount_pct']} AS discount_pct, {_FX['product_category']} AS product_category, "
          f"{_FX['payment_method']} AS payment_method, {_mentions_sql('text')} AS mentions_details FROM support_turns")
def q_extract_order_features(spark, sf_dir):
    f = T.extract_order_features(F.col("text"))
    return support_turns(spark, sf_dir).select(
        "conv_id", "turn", f["price_inr"].alias("price_inr"), f["discount_pct"].alias("discount_pct"),
        f["product_category"].alias("product_category"), f["payment_method"].alias("payment_method"),
        T.mentions_details(F.col("text")).alias("mentions_details"))


@register("image_path_carry", f"WITH {_routed_sql()} SELECT conv_id, turn, image_path FROM ctx WHERE intent = '{T.IMAGE}'")
def q_image_path_carry(spark, sf_dir):
    return resolved_turns(spark, sf_dir).where(F.col("intent") == T.IMAGE).select("conv_id", "turn", "image_path")


PICTURE_TURNS = f"""picture_turns AS (
  SELECT coalesce(vec_id, -1) // 8 AS conv_id, coalesce(vec_id, -1) % 8 AS turn,
         CASE WHEN vec_id % 3 = 0 THEN 'Which category is the picture exports/class' || coalesce(label, -1) || '/' || vec_id || '.png of?'
              ELSE 'Please classify the same image once more' END AS text
  FROM embeddings)"""


def picture_turns(spark, sf_dir) -> DataFrame:
    """The exported pictures as image turns, eight to a conversation: every third id names its picture, the others carry it."""
    vec = F.col("vec_id")
    named = F.concat(F.lit("Which category is the picture exports/class"), F.coalesce("label", F.lit(-1)).cast("string"), F.lit("/"), vec.cast("string"),
                     F.lit(".png of?"))
    key = F.coalesce(vec, F.lit(-1)).cast("long")
    return read_table(spark, sf_dir, "embeddings", ["vec_id", "label"]).select(
        F.expr("coalesce(vec_id, -1) div 8").alias("conv_id"), (key % 8).alias("turn"),
        F.when(vec % 3 == 0, named).otherwise("Please classify the same image once more").alias("text"))


@register("picture_path_carry", f"WITH {_routed_sql().replace(_turns_sql(), PICTURE_TURNS + ', support_turns AS (SELECT * FROM picture_turns)')} "
          f"SELECT conv_id, turn, image_path FROM ctx WHERE intent = '{T.IMAGE}'")
def q_picture_path_carry(spark, sf_dir):
    turns = MS.carry_context(MS.guard_and_route(picture_turns(spark, sf_dir)))
    return turns.where(F.col("intent") == T.IMAGE).select("conv_id", "turn", "image_path")


@register("order_context_carry", f"WITH {_resolved_sql()} SELECT conv_id, turn, mentions_details, price_inr, discount_pct, "
          f"product_category, payment_method FROM resolved WHERE intent = '{T.RISK}'")
def q_order_context_carry(spark, sf_dir):
    return _order_context(resolved_turns(spark, sf_dir))


def _order_context(resolved: DataFrame) -> DataFrame:
    f = F.col("order_features")
    return resolved.where(F.col("intent") == T.RISK).select(
        "conv_id", "turn", "mentions_details", f["price_inr"].alias("price_inr"), f["discount_pct"].alias("discount_pct"),
        f["product_category"].alias("product_category"), f["payment_method"].alias("payment_method"))


@register("order_context_batches", ORACLE["order_context_carry"])
def q_order_context_batches(spark, sf_dir):
    """C9 over the turns in two batches, before and from the middle turn number on; the second reads its own turns and the carries."""
    turns = support_turns(spark, sf_dir)
    middle = (turns.agg(F.max("turn")).first()[0] or 0) // 2
    path = new_folder(spark, "conversation-carries")
    first, second = (MS.carry_context(MS.guard_and_route(turns.where(half)), batch=(path, i)) for i, half in enumerate(
        (F.coalesce(F.col("turn") <= middle, F.lit(True)), F.col("turn") > middle)))
    return _order_context(first.unionByName(second))


_FRESH = _features_sql("s.text")


@register("context_reset", f"WITH {_resolved_sql()} SELECT conv_id, turn, price_inr AS carried_price, "
          f"{_FRESH['price_inr']} AS fresh_price, product_category AS carried_category, "
          f"{_FRESH['product_category']} AS fresh_category, payment_method AS carried_payment, "
          f"{_FRESH['payment_method']} AS fresh_payment FROM resolved r JOIN support_turns s USING (conv_id, turn) "
          f"WHERE r.intent = '{T.RISK}' AND NOT r.mentions_details")
def q_context_reset(spark, sf_dir):
    """A bare follow-up resolved with its conversation's history against a fresh state."""
    r = resolved_turns(spark, sf_dir).where((F.col("intent") == T.RISK) & ~F.col("mentions_details"))
    c, fr = F.col("order_features"), T.extract_order_features(F.col("text"))
    return r.select("conv_id", "turn", c["price_inr"].alias("carried_price"), fr["price_inr"].alias("fresh_price"),
                    c["product_category"].alias("carried_category"), fr["product_category"].alias("fresh_category"),
                    c["payment_method"].alias("carried_payment"), fr["payment_method"].alias("fresh_payment"))


@register("compose_answer")
def q_compose_answer(spark, sf_dir):
    a = answered_turns(spark, sf_dir)
    return a.select("conv_id", "turn", "route", "intent", "risk_bucket", "answer", "source",
                    F.round("answer_confidence", 4).alias("confidence"))


@register("transcripts_written", "SELECT conv_id, count(*) + 1 AS n_lines, 1 AS n_titles FROM conversations WHERE role = 'user' GROUP BY conv_id")
def q_transcripts_written(spark, sf_dir):
    """The transcripts written by the sink, packed into a file for each partition, and read back."""
    back = _written_transcripts(spark, sf_dir).select("conv_id", F.explode(F.split(F.rtrim(F.col("text"), F.lit("\n")), "\n")).alias("value"))
    title = F.col("value") == F.format_string("# Conversation %d", F.col("conv_id"))
    return back.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_lines"), F.sum(title.cast("int")).cast("int").alias("n_titles"))


def _written_transcripts(spark, sf_dir):
    import uuid

    from kestrel.session import ensure_checkpoint_dir
    from kestrel.sources import sinks

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/transcripts-{uuid.uuid4().hex}"
    lines = q_transcript_lines(spark, sf_dir).withColumn("line", F.regexp_replace("line", "[\\r\\n]+", " "))  # a line each
    sinks.write_transcripts(lines, path)
    return sinks.read_transcripts(spark, path)


@register("transcript_texts")
def q_transcript_texts(spark, sf_dir):
    """The whole text of every conversation, read back from the packed files by its segments' offsets."""
    parts = F.sort_array(F.collect_list(F.struct("part", "text")))
    whole = _written_transcripts(spark, sf_dir).groupBy("conv_id").agg(F.concat_ws("", F.transform(parts, lambda p: p["text"])).alias("text"))
    return whole.select("conv_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


@register("transcript_lines")
def q_transcript_lines(spark, sf_dir):
    """S8 rows: a title row per conversation (turn -1), then one rendered line per turn with
    the user text, intent, guardrail note, retrieved chunks, tool output and answer JSON."""
    a = answered_turns(spark, sf_dir)
    js = {"ignoreNullFields": "false"}
    retrieved = F.when(F.size("retrieved") > 0, F.array_join(F.transform("retrieved", lambda c: F.format_string(
        '[%s] score=%.4f "%s"', c["chunk_id"], F.round(c["score"], 4), c["chunk_text"])), "; "))
    tool = (F.when(F.col("intent") == T.RISK, F.to_json(F.struct(
                F.round("risk_p", 4).alias("return_probability"), F.col("risk_bucket"), F.col("t_star_rf")), js))
            .when(F.col("intent") == T.IMAGE, F.to_json(F.struct(
                F.col("predicted_class"), F.round("confidence", 4).alias("confidence")), js)))
    answer = F.to_json(F.struct(F.col("answer"), F.col("source"),
                                F.round("answer_confidence", 4).alias("confidence")), js)
    line = F.concat_ws(" | ",
                       F.format_string("Turn %d", F.col("turn")),
                       F.concat(F.lit("User: "), F.col("text")),
                       F.concat(F.lit("Intent: "), F.coalesce(F.col("intent"), F.lit("N/A")), F.lit(" (method: "),
                                F.coalesce(F.col("intent_method"), F.lit("N/A")), F.lit(")")),
                       F.when(F.col("blocked"), F.concat(F.lit("[GUARDRAIL] Blocked -- matched pattern: "),
                                                         F.col("injection_pattern"))),
                       F.when(retrieved.isNotNull(), F.concat(F.lit("Retrieved chunks: "), retrieved)),
                       F.when(tool.isNotNull(), F.concat(F.lit("Tool output: "), tool)),
                       F.concat(F.lit("Agent response: "), answer))
    titles = a.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("long").alias("turn"),
        F.format_string("# Conversation %d", F.col("conv_id")).alias("line"))
    return a.select("conv_id", "turn", line.alias("line")).unionByName(titles)


def _turn_stream(spark, sf_dir) -> DataFrame:
    """Conversations as a file stream (the table's parquet files are the arriving batches)."""
    schema = "conv_id long, turn long, role string, text string"
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true")
           .option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir.rstrip('/')}/conversations.parquet*"))
    return src.where(F.col("role") == "user").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))


@register("order_context_stream", f"WITH {_resolved_sql()} SELECT conv_id, turn, mentions_details, price_inr, discount_pct, "
          f"product_category, payment_method FROM resolved WHERE intent = '{T.RISK}'")
def q_order_context_stream(spark, sf_dir):
    """The carried order context computed by the stateful stream (equals C9, in whatever order files arrive)."""
    from kestrel.streaming.conversations import carry_stream, features_from_source, latest, run_to_table

    out = latest(run_to_table(spark, carry_stream(_turn_stream(spark, sf_dir)), "order-context"))
    out = features_from_source(out.where(F.col("intent") == T.RISK))
    return out.select("conv_id", "turn", "mentions_details", "price_inr", "discount_pct", "product_category",
                      "payment_method")


def policy_sql() -> str:
    """Terms of policy turns and of the knowledge base, their scores and the best three chunks."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(c)}, {quote(d)}, {quote(t)})" for c, d, _, t in KB.chunks())
    n = len(KB.chunks())
    return f"""kb AS (SELECT * FROM (VALUES {rows}) v(chunk_id, doc_id, chunk_text)),
kbt AS (SELECT chunk_id, term, count(*)::DOUBLE AS ctf FROM (SELECT chunk_id, {term_sql('chunk_text')} AS term FROM kb) GROUP BY chunk_id, term),
kbn AS (SELECT chunk_id, sqrt(sum(ctf * ctf)) AS cn FROM kbt GROUP BY chunk_id),
kbw AS (SELECT term, ln({1 + n}::DOUBLE / (1 + count(*))) + 1 AS idf FROM kbt GROUP BY term),
pt AS (SELECT conv_id, turn, term, count(*)::DOUBLE AS tf FROM (
         SELECT conv_id, turn, {term_sql('text')} AS term FROM resolved WHERE intent = '{T.POLICY}') GROUP BY conv_id, turn, term),
pw AS (SELECT conv_id, turn, pt.term, tf * coalesce(idf, ln({1 + n}::DOUBLE) + 1) AS w, idf IS NOT NULL AS held FROM pt LEFT JOIN kbw ON kbw.term = pt.term),
pn AS (SELECT conv_id, turn, sqrt(sum(w * w)) AS qn FROM pw GROUP BY conv_id, turn),
ps AS (SELECT pw.conv_id, pw.turn, kbt.chunk_id, sum(w * ctf / cn) AS dot
       FROM pw JOIN kbt ON kbt.term = pw.term JOIN kbn ON kbn.chunk_id = kbt.chunk_id WHERE held GROUP BY pw.conv_id, pw.turn, kbt.chunk_id),
policy_score AS (SELECT ps.conv_id, ps.turn, ps.chunk_id, kb.doc_id, kb.chunk_text, round(dot / qn, 9) AS score
                 FROM ps JOIN pn ON pn.conv_id = ps.conv_id AND pn.turn = ps.turn JOIN kb ON kb.chunk_id = ps.chunk_id),
policy_top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM policy_score)
               WHERE rank <= {RT.TOP_K})"""


def _compose_sql(final: str | None = None) -> str:
    from kestrel.functions import rules as R
    from kestrel.plans.oracle_orders import order_features_cte, sweep_cte, z_sql
    from kestrel.plans.prep_plans import split_sql, test_scores_sql

    names = "[" + ", ".join(f"'{n}'" for n in T.CLASS_NAMES) + "]"
    d = T.DEFAULT_ORDER_FEATURES
    ratio = d["num_previous_returns"] / d["num_previous_orders"]
    z = z_sql().replace("prev_return_ratio", str(ratio)).replace("delivery_days", str(d["delivery_days"])) \
        .replace("is_weekend_order", str(d["is_weekend_order"])).replace("customer_tenure_days", str(d["customer_tenure_days"]))
    pct = lambda x: f"CAST(CAST(round({x} * 100) AS BIGINT) AS VARCHAR) || '%'"
    deflect = T.DEFLECTION_ANSWER.replace("'", "''")
    return f"""WITH {order_features_cte()}, {split_sql()}, {test_scores_sql()}, {sweep_cte('test_scores')}, {_resolved_sql()}, {policy_sql()},
ts AS (SELECT threshold AS t FROM t_star),
turns AS (
  SELECT r.*,
         CASE WHEN r.intent = '{T.RISK}' THEN 1.0 / (1.0 + exp(-({z}))) END AS risk_p,
         list_last(string_split(r.image_path, '/')) AS file_name
  FROM resolved r),
top12 AS (SELECT conv_id, turn,
           max(CASE WHEN rank = 1 THEN score END) AS top1_score, max(CASE WHEN rank = 1 THEN doc_id END) AS top1_doc,
           max(CASE WHEN rank = 1 THEN chunk_text END) AS top1_text,
           max(CASE WHEN rank = 2 THEN doc_id END) AS top2_doc, max(CASE WHEN rank = 2 THEN chunk_text END) AS top2_text,
           max(CASE WHEN rank = 2 THEN score END) AS top2_score,
           string_agg('[' || chunk_id || '] score=' || printf('%.4f', round(score, 4)) || ' "' || chunk_text || '"', '; ' ORDER BY rank) AS retrieved
          FROM policy_top GROUP BY conv_id, turn),
el AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
cent AS (SELECT label AS c, list(m ORDER BY pos) AS centroid FROM (
           SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM el GROUP BY label, pos) GROUP BY label),
iv AS (SELECT min(vec_id) AS ivec, printf('%02d_%s.png', label, {names}[label + 1]) AS file_name FROM embeddings GROUP BY label),
lg AS (SELECT iv.ivec, iv.file_name, c.c, list_dot_product(CAST(e.embedding AS DOUBLE[]), c.centroid) AS l
       FROM iv JOIN embeddings e ON e.vec_id = iv.ivec JOIN cent c ON true),
mx AS (SELECT ivec, max(l) AS lmax FROM lg GROUP BY ivec),
img AS (SELECT g.file_name, {names}[min(CASE WHEN g.l = m.lmax THEN g.c END) + 1] AS cls,
               round(1.0 / sum(exp(g.l - m.lmax)), 4) AS conf FROM lg g JOIN mx m USING (ivec) GROUP BY g.file_name),
j AS (SELECT t.*, p.top1_score, p.top1_doc, p.top1_text, p.top2_doc, p.top2_text, p.top2_score, p.retrieved, i.cls, i.conf, ts.t,
             coalesce(p.top1_score, 0.0) AS top,
             CASE WHEN t.risk_p < ts.t THEN 'Low' WHEN t.risk_p >= ts.t + {R.HIGH_BUCKET_MARGIN} THEN 'High' ELSE 'Medium' END AS bucket
      FROM turns t LEFT JOIN top12 p ON p.conv_id = t.conv_id AND p.turn = t.turn LEFT JOIN img i ON i.file_name = t.file_name, ts)
, answers AS (
SELECT conv_id, turn, route, intent, text, intent_method, blocked, injection_pattern,
  top1_text, top1_score, top2_text, top2_score, retrieved, risk_p, t, cls, conf,
  CASE WHEN intent = '{T.RISK}' THEN bucket END AS risk_bucket,
  CASE WHEN route = 'deflect' THEN '{deflect}'
       WHEN intent = '{T.POLICY}' AND top >= 0.45 THEN
            CASE WHEN top2_doc = top1_doc THEN top1_text || ' ' || top2_text ELSE top1_text END
       WHEN intent = '{T.POLICY}' THEN {T.render_sql(T.UNGROUNDED_ANSWER, top="CAST(round(top, 4) AS VARCHAR)", thr="'0.45'")}
       WHEN intent = '{T.RISK}' THEN {T.render_sql(T.RISK_ANSWER, pct=pct('round(risk_p, 4)'), bucket='bucket', t='CAST(t AS VARCHAR)')}
       WHEN intent = '{T.IMAGE}' THEN coalesce({T.render_sql(T.IMAGE_ANSWER, cls='cls', pct=pct('conf'))}, '{T.NO_IMAGE_ANSWER}')
  END AS answer,
  CASE WHEN route = 'deflect' OR intent = '{T.POLICY}' THEN 'policy_kb' WHEN intent = '{T.RISK}' THEN 'return_risk_tool'
       WHEN intent = '{T.IMAGE}' THEN 'image_classifier_tool' END AS source,
  round(CASE WHEN route = 'deflect' THEN 0.0 WHEN intent = '{T.POLICY}' AND top >= 0.45 THEN round(top, 4)
             WHEN intent = '{T.POLICY}' THEN 0.0 WHEN intent = '{T.RISK}' THEN round(risk_p, 4)
             WHEN intent = '{T.IMAGE}' THEN coalesce(round(conf, 4), 0.0) END, 4) AS confidence
FROM j)
""" + (final or "SELECT conv_id, turn, route, intent, risk_bucket, answer, source, confidence FROM answers")


ORACLE["compose_answer"] = _compose_sql()
ORACLE["transcript_lines"] = _compose_sql(
    "SELECT conv_id, turn, concat_ws(' | ', 'Turn ' || CAST(turn AS VARCHAR), 'User: ' || text, "
    "'Intent: ' || coalesce(intent, 'N/A') || ' (method: ' || coalesce(intent_method, 'N/A') || ')', "
    "CASE WHEN blocked THEN '[GUARDRAIL] Blocked -- matched pattern: ' || injection_pattern END, "
    "'Retrieved chunks: ' || retrieved, "
    f"CASE WHEN intent = '{T.RISK}' THEN 'Tool output: ' || json_object('return_probability', round(risk_p, 4), "
    "'risk_bucket', risk_bucket, 't_star_rf', t)::VARCHAR "
    f"WHEN intent = '{T.IMAGE}' THEN 'Tool output: ' || json_object('predicted_class', cls, 'confidence', round(conf, 4))::VARCHAR END, "
    "'Agent response: ' || json_object('answer', answer, 'source', source, 'confidence', confidence)::VARCHAR) AS line "
    "FROM answers UNION ALL SELECT DISTINCT conv_id, CAST(-1 AS BIGINT) AS turn, '# Conversation ' || CAST(conv_id AS VARCHAR) AS line "
    "FROM answers")


ORACLE["transcript_texts"] = ("SELECT conv_id, CAST(length(text) AS INTEGER) AS n_chars, sha256(text) AS text_sha256 FROM (SELECT conv_id, "
                              "string_agg(regexp_replace(line, '[\\r\\n]+', ' ', 'g') || chr(10), '' ORDER BY turn) AS text FROM (" + ORACLE["transcript_lines"] + ") GROUP BY conv_id)")


_GROUND = f"""grd AS (SELECT r.conv_id, r.turn, round(coalesce(max(p.score), 0.0), 4) AS top_score,
  coalesce(max(p.score), 0.0) >= {RT.GROUNDEDNESS_THRESHOLD} AS grounded
  FROM resolved r LEFT JOIN policy_top p ON p.conv_id = r.conv_id AND p.turn = r.turn WHERE r.intent = '{T.POLICY}' GROUP BY r.conv_id, r.turn)"""


@register("policy_text_retrieval", f"WITH {_resolved_sql()}, {policy_sql()}, {_GROUND} SELECT grd.conv_id, grd.turn, p.rank, p.chunk_id, "
          "round(p.score, 4) AS score, grd.top_score, grd.grounded FROM grd LEFT JOIN policy_top p ON p.conv_id = grd.conv_id AND p.turn = grd.turn")
def q_policy_text_retrieval(spark, sf_dir):
    """R3-R5 on messages: every policy turn's text against the knowledge base, with the groundedness flag."""
    turns = resolved_turns(spark, sf_dir).where(F.col("intent") == T.POLICY).select("conv_id", "turn", "intent", "text")
    found = policy_retrieval(turns)
    top = F.coalesce(F.max("score"), F.lit(0.0))
    out = turns.select("conv_id", "turn").join(found, ["conv_id", "turn"], "left")
    ground = out.groupBy("conv_id", "turn").agg(F.round(top, 4).alias("top_score"), (top >= RT.GROUNDEDNESS_THRESHOLD).alias("grounded"))
    return out.join(ground, ["conv_id", "turn"]).select("conv_id", "turn", "rank", "chunk_id", F.round("score", 4).alias("score"), "top_score", "grounded")


_DX = _features_sql("text")


@register("document_message_scan", f"SELECT doc_id, {_inj_sql('text')} AS injection_pattern, {_exemplar_sql('text')} AS exemplar_intent, "
          f"{_keyword_sql('text')} AS keyword_intent, coalesce({_exemplar_sql('text')}, {_keyword_sql('text')}, '{T.POLICY}') AS intent, "
          f"{_DX['price_inr']} AS price_inr, {_DX['discount_pct']} AS discount_pct, {_DX['product_category']} AS product_category, "
          f"{_DX['payment_method']} AS payment_method, {_mentions_sql('text')} AS mentions_details FROM documents")
def q_document_message_scan(spark, sf_dir):
    """C1-C4, C6, C7 over the whole texts of ``documents``: one pass finds the rules' literals, patterns see candidates only."""
    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return scan_messages(docs)


def scan_messages(docs: DataFrame) -> DataFrame:
    """``doc_id`` and what the text rules say of ``text`` (null texts: as the rules say of null)."""
    t = F.col("text")
    scan = LS.Scan(t, T.all_literals())
    rows = docs.select("doc_id", "text", scan.mask.alias("_found"))
    found = F.col("_found")
    has = lambda w: scan.has(found, w) & t.isNotNull()
    any_of = lambda words: reduce(or_, [has(w) for w in words])
    injection = F.coalesce(*[F.when(scan.may_match(found, LS.runs(p)) & t.rlike("(?iu)" + p), F.lit(p)) for p in T.INJECTION_PATTERNS])
    # an exemplar shares three tokens with a text only if three of its tokens stand in it
    share = reduce(or_, [reduce(add, [has(w).cast("int") for w in dict.fromkeys(ex.split())]) >= T.EXEMPLAR_MIN_OVERLAP for ex, _ in T.FEW_SHOT_EXAMPLES])
    # each text is cut into tokens once, not for each exemplar
    rows = rows.withColumn("_tokens", F.when(share, T.exemplar_tokens(t)))
    exemplar = F.when(F.col("_tokens").isNotNull(), T.intent_of_tokens(F.col("_tokens")))
    keyword = F.when(any_of(T.IMAGE_KEYWORDS), F.lit(T.IMAGE)).when(any_of(T.RISK_KEYWORDS), F.lit(T.RISK)).when(any_of(T.POLICY_KEYWORDS), F.lit(T.POLICY))
    digits = scan.may_match(found, [LS.THREE_DIGITS])
    price = F.when(digits, F.nullif(F.regexp_extract(t, "(?iu)" + T.PRICE_PATTERN, 1), F.lit("")).cast("double"))
    discount = F.when(scan.may_match(found, ["discount"]), F.nullif(F.regexp_extract(t, "(?iu)" + T.DISCOUNT_PATTERN, 1), F.lit("")).cast("double"))
    first = lambda pairs: F.coalesce(*[F.when(any_of(words), F.lit(name)) for name, words in pairs])
    category = first([(c, [c.lower()]) for c in CATEGORIES])
    payment = first([("COD", T.CASH_ON_DELIVERY), *((p, [p.lower().replace("_", " "), p.lower()]) for p in PAYMENT_METHODS)])
    d = T.DEFAULT_ORDER_FEATURES
    details = F.when(t.isNotNull(), (digits & t.rlike("(?iu)" + r"(?:price|₹|rs\.?)\s*\d{3,7}")) | category.isNotNull())
    rows = rows.withColumns({"injection_pattern": injection, "exemplar_intent": exemplar, "keyword_intent": keyword})  # each once
    return rows.select("doc_id", "injection_pattern", "exemplar_intent", "keyword_intent", F.coalesce("exemplar_intent", "keyword_intent", F.lit(T.POLICY)).alias("intent"),
                       F.coalesce(price, F.lit(d["price_inr"])).alias("price_inr"), F.coalesce(discount, F.lit(d["discount_pct"])).alias("discount_pct"),
                       F.coalesce(category, F.lit(d["product_category"])).alias("product_category"), F.coalesce(payment, F.lit(d["payment_method"])).alias("payment_method"),
                       details.alias("mentions_details"))
