"""Line dedup by distinct-site spread.

Lines (trimmed of ASCII white space; blank ones aside) are keyed by two 64-bit hashes.  One HyperLogLog sketch
of sites per line merges by aggregation, map side first.  Lines whose estimate is clearly over or under
``min_sites`` are decided by it; those within the sketch's error of the threshold get an exact distinct count.
Lines on ``min_sites`` sites or more are cross-site boilerplate: all their occurrences go but the first (by
document id), so a text that many sites copy stays whole once.

Defined results: a null text stays null (no lines); a document that loses every line has an empty text; a null
site is a site of its own; repeated rows are treated alike; rows with one ``doc_id`` and different texts stay
apart; all columns of the input are kept (but ones named as the two counts); a long text is split inside its row; an empty table gives an empty result.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import written

MIN_SITES = 10
LG_K = 12
BLANK = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def lines_of(docs: DataFrame, site: str) -> DataFrame:
    """(row key, line number, line key, site) of every line that is not blank."""
    rows = docs.select(F.col("doc_id").alias("d"), F.hash("text").alias("th"), F.coalesce(F.col(f"`{site}`").cast("string"), F.lit("\x00none")).alias("site"),
                       F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    rows = rows.withColumn("line", F.regexp_replace("line", BLANK, "")).filter("line <> ''")
    return rows.select("d", "th", "no", "site", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def cross_site_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """Keys (h1, h2) of the lines that stand on ``min_sites`` sites or more."""
    spread = written(lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"), F.count("*").alias("c"))
                     .filter(F.col("c") >= min_sites).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites")), "line-spread")
    slack = math.ceil(1 + min_sites * 5 * 1.04 / math.sqrt(1 << lg_k))  # five standard errors of the sketch
    sure = spread.filter(F.col("sites") > min_sites + slack).select("h1", "h2")
    near = spread.filter(F.abs(F.col("sites") - min_sites) <= slack).select("h1", "h2")
    exact = (lines.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count("*").alias("sites"))
             .filter(F.col("sites") >= min_sites).select("h1", "h2"))
    return sure.unionByName(exact)


def deduped(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``row`` (the input's row as it came), ``text`` without cross-site lines, ``n_lines`` and ``n_removed``."""
    lines = written(lines_of(docs, site), "lines")
    common = written(cross_site_lines(lines, min_sites, lg_k), "cross-site-lines")
    hits = lines.join(common, ["h1", "h2"]).select("d", "th", "no", "h1", "h2")
    place = F.struct("d", "th", "no")
    # written, so that the join below reads it anew and can split a line that many documents hold
    first = written(hits.groupBy("h1", "h2").agg(F.min(place).alias("first")), "first-lines")
    again = hits.join(first, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    gone = again.groupBy("d", "th").agg(F.array_distinct(F.collect_list("no")).alias("gone"))
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.select(F.struct(*own).alias("row"), F.col("doc_id").alias("d0"), F.hash("text").alias("th0"))
    joined = keyed.join(gone, F.col("d0").eqNullSafe(F.col("d")) & (F.col("th0") == F.col("th")), "left")
    split = F.split("row.text", "\n", -1)
    size = F.size(split)
    stay = F.array_except(F.sequence(F.lit(0), size - 1), F.col("gone"))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(
        F.array_join(F.transform(F.array(split), lambda parts: F.transform(stay, lambda i: F.get(parts, i)))[0], "\n"))
    return joined.select("row", text.alias("text"), F.when(F.col("row.text").isNull(), 0).otherwise(size).cast("bigint").alias("n_lines"),
                         F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("bigint").alias("n_removed"))


def dedup_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``docs`` with cross-site lines taken out of ``text``; two columns more, ``n_lines`` and ``n_removed``, in the place of any of
    these names (in whatever case) in ``docs``."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    out = deduped(docs, site, min_sites, lg_k)
    return out.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in own], "n_lines", "n_removed")


def dedup_sql(min_sites: int = MIN_SITES) -> str:
    """``doc_id, n_lines, n_removed, kept_sha256`` in DuckDB SQL, over lines themselves instead of their hashes."""
    return f"""
with s as (select doc_id, source, text, string_split(text, chr(10)) as parts from documents),
l as (select doc_id, coalesce(source, '') as site, no, regexp_replace(part, '{BLANK}', '', 'g') as line, part
      from (select doc_id, source, unnest(parts) as part, unnest(range(len(parts))) as no from s)),
b as (select line from l where line <> '' group by line having count(distinct site) >= {min_sites}),
r as (select doc_id, no, row_number() over (partition by line order by doc_id, no) > 1 as again from l semi join b using (line)),
k as (select l.doc_id, string_agg(part, chr(10) order by l.no) filter (not coalesce(again, false)) as kept, count(*) filter (again) as n_removed
      from l left join r on l.doc_id = r.doc_id and l.no = r.no group by l.doc_id)
select s.doc_id, coalesce(len(parts), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed,
  case when text is not null then sha256(coalesce(kept, '')) end as kept_sha256
from s left join k on s.doc_id = k.doc_id"""
