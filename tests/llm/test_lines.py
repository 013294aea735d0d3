import random
import re
from collections import Counter

from kestrel.llm.lines import cross_site_lines, dedup_lines, lines_of


def strip(x):
    return re.sub("^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x)


def brute(rows, min_sites):
    sites, first = {}, {}
    for i, t, s in rows:
        for no, x in enumerate((t or "").split("\n")):
            x = strip(x)
            if t is not None and x:
                sites.setdefault(x, set()).add(s)
                first[x] = min(first.get(x, (i, no)), (i, no))
    out = Counter()
    for i, t, s in rows:
        if t is None:
            out[i, None, 0, 0] += 1
            continue
        lines = t.split("\n")
        kept = [x for no, x in enumerate(lines) if not strip(x) or len(sites[strip(x)]) < min_sites or first[strip(x)] == (i, no)]
        out[i, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


def corpus(seed):
    rnd = random.Random(seed)
    common = [f"common line {i}" for i in range(12)]
    rows = []
    for i in range(160):
        lines = [rnd.choice([f"own {rnd.randrange(10**6)}", " ", "", rnd.choice(common[: 1 + i % 12]), " " + rnd.choice(common) + "\t", "é" * rnd.randrange(4)]) for _ in range(rnd.randrange(9))]
        rows.append((i, "\n".join(lines), rnd.choice([None, *[f"s{k}" for k in range(14)]])))
    return rows + [(500, None, "s1"), (501, "", "s1"), (502, "\n".join(common * 2000), "s2"), rows[3], rows[3]]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, 1, "x") for i, t, s in rows], "doc_id bigint, text string, source string, th int, gone string").repartition(3)


def test_equals_brute_force(shared):
    for seed, min_sites in ((1, 3), (2, 10)):
        rows = corpus(seed)
        out = dedup_lines(frame(shared, rows), min_sites=min_sites)
        assert out.columns == ["doc_id", "text", "source", "th", "gone", "n_lines", "n_removed"]
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_removed) for r in out.collect()) == brute(rows, min_sites)
    assert dedup_lines(frame(shared, rows).limit(0)).count() == 0


def test_many_sites_by_sketch_and_exact_counts(shared):
    rows = [(k * 1000 + s, f"line {k}", f"site {s}") for k, n in ((1, 300), (2, 199), (3, 200), (4, 201), (5, 260), (6, 130)) for s in range(n)]
    lines = lines_of(frame(shared, rows), "source")
    keys = cross_site_lines(lines, min_sites=200, lg_k=10)
    found = {r.line for r in shared.createDataFrame([(f"line {k}",) for k in range(1, 7)], "line string").selectExpr("line", "xxhash64(line) h1").join(keys, "h1").collect()}
    assert found == {"line 1", "line 3", "line 4", "line 5"}


def test_columns_of_the_counts_names_give_way(docs_of):
    docs = docs_of([(1, "a\nb")]).selectExpr("*", "'x' as n_removed", "'y' as N_Lines", "1 as `a.b`", "2 as row")
    out = dedup_lines(docs)
    assert out.columns == [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")] + ["n_lines", "n_removed"]
    r = out.first()
    assert (r.n_lines, r.n_removed, r["a.b"], r.text) == (2, 0, 1, "a\nb")
