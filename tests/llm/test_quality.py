import random
import re
from collections import Counter

from kestrel.llm.quality import HOST_LIMIT, judge
from kestrel.llm.queries import ORACLE

COLUMNS = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def base(doc, text):
    text = text or ""
    words = re.findall("[^\x20\x09-\x0D]+", text)
    runs = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    seen = Counter(runs)
    repeat = {i + k for i, r in enumerate(runs) if seen[r] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0D]", x)]
    return (doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat),
            len(words) < 50 or 100 * len(repeat) > 50 * len(words))


def corpus():
    rnd = random.Random(9)
    rows = []
    for i in range(200):
        n = rnd.choice([0, 1, 2, 3, 4, 5, 30, 60, 200])
        size = rnd.choice([2, 5, 400])
        rows.append((i, "".join(f"{rnd.choice(['a', 'é#', 'x|$', '<w'])}{rnd.randrange(size)}{rnd.choice([' ', chr(10), '  ', chr(9), chr(11), chr(0x85), chr(0xA0)])}" for _ in range(n))))
    return rows + [(300, None), (301, ""), (302, "a a a a"), (303, "a a a"), (304, "\n\n \n"), (305, "a b c " * 30000), (None, "x y z " * 30), rows[1], rows[1]]


def test_base_counts(docs_of):
    rows = corpus()
    got = Counter(tuple(r[c] for c in COLUMNS) for r in judge(docs_of(rows)).collect())
    assert got == Counter(base(*r) for r in rows)
    assert judge(docs_of([]).limit(0)).count() == 0


def test_hosts(shared):
    clean = " ".join(f"word{i}" for i in range(80))
    rows = [(i, clean, "good") for i in range(40)] + [(100 + i, clean if i % 10 == 0 else "short one", "bad") for i in range(200)]
    rows += [(400, "short", "tiny"), (401, clean, None), (402, None, None)]
    got = {r.doc_id: r for r in judge(shared.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert got[0].kept and not got[0].host_failed
    assert got[100].host_failed and not got[100].base_failed and not got[100].kept
    assert not got[402].kept and len(got) == len(rows)
    assert got[400].host_rate < 1 and 0 < got[0].host_rate < HOST_LIMIT  # shrunk both ways


def test_no_python_in_plan(shared, docs_of):
    plan = judge(docs_of(corpus()[:5]))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_sql_on_edge_rows(docs_of, duck):
    rows = corpus()[:200] + [(300, None), (301, ""), (302, "a a a a")]
    import pandas as pd

    duck.execute("create schema if not exists own")
    documents = pd.DataFrame([(i, t, f"h{i % 7}") for i, t in rows], columns=["doc_id", "text", "source"])
    duck.register("own_documents", documents)
    want = duck.execute(ORACLE["op1_quality_rules"].replace("from documents", "from own_documents")).fetchall()
    df = docs_of(rows).drop("source").selectExpr("*", "concat('h', doc_id % 7) source")
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in judge(df).collect())
