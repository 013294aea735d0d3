"""Rule tables for support-message processing, and column expressions built from them.

Everything in the FIXED VALUES block must stay exactly as written: the guardrail
patterns, intent exemplars and keywords, order-feature defaults, extraction patterns and
answer templates decide the results that are checked.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kestrel.functions.rules import CATEGORIES, PAYMENT_METHODS

# ---------------------------------------------------------------------------------------
# FIXED VALUES
# Prompt-injection patterns, checked in this order; the first match is reported.
INJECTION_PATTERNS = [
    r"ignore (all )?(previous|prior|above) instructions",
    r"ignore all rules",
    r"disregard (your|the) (instructions|rules|prompt)",
    r"pretend you are",
    r"pretend to be",
    r"act as if you (are|were)",
    r"you are now",
    r"forget (everything|all) (you were told|above)",
    r"reveal your (system prompt|instructions)",
    r"what (is|are) your (system prompt|instructions)",
]
# Intent exemplars (text, intent), checked in this order; a match shares >= 3 tokens.
FEW_SHOT_EXAMPLES = [
    ("how many days do i have to return a shirt", "policy_question"),
    ("will order be returned", "return_risk_query"),
    ("what category is this product photo", "product_category_query"),
    ("when will my refund arrive", "policy_question"),
    ("is this order likely to come back as a return", "return_risk_query"),
    ("classify this image for me", "product_category_query"),
]
EXEMPLAR_MIN_OVERLAP = 3
# Keyword fallback, checked in the order image, risk, policy (substring match).
POLICY_KEYWORDS = [
    "return window", "refund", "delivery", "deliver", "exchange", "pickup",
    "pick up", "cancel", "policy", "return", "ship", "cod", "days", "sla",
]
RISK_KEYWORDS = [
    "risk", "likely to be returned", "return probability", "will be returned",
    "return risk", "order features", "check_return_risk", "predict",
]
IMAGE_KEYWORDS = [
    "image", "photo", "picture", "category is this", "classify", "png", "product photo",
]
# Order features used when a message does not state them.
DEFAULT_ORDER_FEATURES = {
    "price_inr": 1500.0, "discount_pct": 20.0, "customer_tenure_days": 100,
    "num_previous_orders": 3, "num_previous_returns": 0,
    "delivery_distance_km": 150.0, "delivery_days": 4,
    "is_weekend_order": 0, "rating_given": None,
    "product_category": "Apparel", "payment_method": "COD",
}
# Extraction patterns (searched anywhere, case-insensitive).
PRICE_PATTERN = r"(?:price|₹|rs\.?)\s*(\d{3,7})"
DISCOUNT_PATTERN = r"(\d{1,2})\s*%\s*discount"
IMAGE_PATH_PATTERN = r"([\w./-]+\.png)"
CASH_ON_DELIVERY = ["cod", "cash on delivery"]
# Answer templates.
DEFLECTION_ANSWER = ("Your message tries to steer how this assistant works, and that is not something a message can do. "
                     "Ask about a delivery, a refund, a return or the risk of an order and you get an answer.")
NO_IMAGE_ANSWER = "No stored product picture has the name you gave."
REFUSAL_PREFIX = "I can't answer that confidently: "
UNGROUNDED_ANSWER = (REFUSAL_PREFIX + "no retrieved policy chunk cleared the similarity threshold "
                     "(top score {top} < threshold {thr}).")
RISK_ANSWER = ("This order has an estimated return probability of {pct}, which places it in the '{bucket}' "
               "risk bucket (anchored to this model's own threshold t*_rf={t}).")
IMAGE_ANSWER = "This product image is classified as '{cls}' with {pct} confidence."
# Class names in label order (label id = position).
CLASS_NAMES = ["tshirt_top", "trouser", "pullover", "dress", "coat",
               "sandal", "shirt", "sneaker", "bag", "ankle_boot"]
# ---------------------------------------------------------------------------------------

POLICY, RISK, IMAGE = "policy_question", "return_risk_query", "product_category_query"


def all_literals() -> list[str]:
    """Every literal that the rules look for: what keyword rules ask for, and what patterns and exemplars cannot match without."""
    from kestrel.functions.literal_scan import runs

    payments = [w for p in PAYMENT_METHODS for w in (p.lower(), p.lower().replace("_", " "))]
    return [*(r for p in INJECTION_PATTERNS for r in runs(p)), *(w for ex, _ in FEW_SHOT_EXAMPLES for w in ex.split()), *IMAGE_KEYWORDS, *RISK_KEYWORDS, *POLICY_KEYWORDS,
            *(c.lower() for c in CATEGORIES), *payments, *CASH_ON_DELIVERY, "discount"]


def injection_pattern(text: Column) -> Column:
    """The first pattern (in list order) found anywhere in the text, else null."""
    return F.coalesce(*[F.when(text.rlike("(?iu)" + p), F.lit(p)) for p in INJECTION_PATTERNS])


def tokens(text: Column) -> Column:
    """Lower-cased whitespace tokens as a set (punctuation stays attached)."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda t: t != ""))


def exemplar_intent(text: Column) -> Column:
    """Intent of the first exemplar sharing at least 3 tokens, else null."""
    return intent_of_tokens(tokens(text))


def exemplar_tokens(text: Column) -> Column:
    """The different tokens of a text that stand in any exemplar: all that ``intent_of_tokens`` needs of a long text."""
    every = dict.fromkeys(t for ex, _ in FEW_SHOT_EXAMPLES for t in ex.split())
    return F.array_intersect(tokens(text), F.array(*map(F.lit, every)))


def intent_of_tokens(toks: Column) -> Column:
    """C2 of a text's tokens."""
    arms = []
    for ex, intent in FEW_SHOT_EXAMPLES:
        ex_toks = F.array(*[F.lit(t) for t in dict.fromkeys(ex.split())])
        arms.append(F.when(F.size(F.array_intersect(toks, ex_toks)) >= EXEMPLAR_MIN_OVERLAP, F.lit(intent)))
    return F.coalesce(*arms)


def _contains_any(lower_text: Column, words: list[str]) -> Column:
    cond = None
    for w in words:
        c = lower_text.contains(w)
        cond = c if cond is None else cond | c
    return cond


def keyword_intent(text: Column) -> Column:
    """Image, then risk, then policy keywords; null when none matches."""
    low = F.lower(text)
    return (F.when(_contains_any(low, IMAGE_KEYWORDS), F.lit(IMAGE))
            .when(_contains_any(low, RISK_KEYWORDS), F.lit(RISK))
            .when(_contains_any(low, POLICY_KEYWORDS), F.lit(POLICY)))


def classify_intent(text: Column) -> Column:
    """C4: struct(intent, method) - exemplar match, keyword fallback, or default policy."""
    ex = exemplar_intent(text)
    kw = keyword_intent(text)
    intent = F.coalesce(ex, kw, F.lit(POLICY))
    method = (F.when(ex.isNotNull(), F.lit("few_shot_match"))
              .when(kw.isNotNull(), F.lit("keyword_fallback")).otherwise(F.lit("default_fallback")))
    return F.struct(intent.alias("intent"), method.alias("method"))


def mentions_details(text: Column) -> Column:
    """A price pattern or a known category is mentioned (payment/discount do not count)."""
    has_price = text.rlike("(?iu)" + r"(?:price|₹|rs\.?)\s*\d{3,7}")
    return has_price | _contains_any(F.lower(text), [c.lower() for c in CATEGORIES])


def extract_order_features(text: Column) -> Column:
    """Order features stated in the text, layered over the defaults (struct column)."""
    low = F.lower(text)
    price = F.nullif(F.regexp_extract(text, "(?iu)" + PRICE_PATTERN, 1), F.lit("")).cast("double")
    disc = F.nullif(F.regexp_extract(text, "(?iu)" + DISCOUNT_PATTERN, 1), F.lit("")).cast("double")
    cat = None
    for c in CATEGORIES:
        cond = low.contains(c.lower())
        cat = F.when(cond, F.lit(c)) if cat is None else cat.when(cond, F.lit(c))
    pay = None
    for p in PAYMENT_METHODS:
        cond = low.contains(p.lower().replace("_", " ")) | low.contains(p.lower())
        pay = F.when(cond, F.lit(p)) if pay is None else pay.when(cond, F.lit(p))
    pay = F.when(_contains_any(low, CASH_ON_DELIVERY), F.lit("COD")).otherwise(pay)
    d = DEFAULT_ORDER_FEATURES
    return F.struct(
        F.coalesce(price, F.lit(d["price_inr"])).alias("price_inr"),
        F.coalesce(disc, F.lit(d["discount_pct"])).alias("discount_pct"),
        F.lit(d["customer_tenure_days"]).alias("customer_tenure_days"),
        F.lit(d["num_previous_orders"]).alias("num_previous_orders"),
        F.lit(d["num_previous_returns"]).alias("num_previous_returns"),
        F.lit(d["delivery_distance_km"]).alias("delivery_distance_km"),
        F.lit(d["delivery_days"]).alias("delivery_days"),
        F.lit(d["is_weekend_order"]).alias("is_weekend_order"),
        F.lit(None).cast("double").alias("rating_given"),
        F.coalesce(cat, F.lit(d["product_category"])).alias("product_category"),
        F.coalesce(pay, F.lit(d["payment_method"])).alias("payment_method"),
    )


def image_path(text: Column) -> Column:
    """The first ``.png`` path in the text, else null."""
    return F.nullif(F.regexp_extract(text, IMAGE_PATH_PATTERN, 1), F.lit(""))


def _parts(template: str) -> list[tuple[bool, str]]:
    """Split ``"a {x} b"`` into [(False, "a "), (True, "x"), (False, " b")]."""
    import re

    out, pos = [], 0
    for m in re.finditer(r"\{(\w+)\}", template):
        if m.start() > pos:
            out.append((False, template[pos:m.start()]))
        out.append((True, m.group(1)))
        pos = m.end()
    if pos < len(template):
        out.append((False, template[pos:]))
    return out


def render(template: str, **values: Column) -> Column:
    """An answer template as a string column (null when any placeholder value is null)."""
    return F.concat(*[values[v] if is_var else F.lit(v) for is_var, v in _parts(template)])


def render_sql(template: str, **values: str) -> str:
    """The same template as a SQL string expression (for the oracle)."""
    lit = lambda t: "'" + t.replace("'", "''") + "'"
    return "(" + " || ".join(f"({values[v]})" if is_var else lit(v) for is_var, v in _parts(template)) + ")"


def percent0(p: Column) -> Column:
    """``{p:.0%}``-style text; halves round up (Python rounds them to even)."""
    return F.concat(F.round(p * 100, 0).cast("long").cast("string"), F.lit("%"))
